"""Text jobs as batch columns: features, intent, goals, facts and rules from surface patterns, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs

# Word lists of the features.
WH = ["what", "who", "where", "when", "why", "how", "which"]
AUX = ["is", "are", "was", "were", "do", "does", "did", "has", "have", "had"]
MODAL = ["can", "could", "may", "might", "must", "shall", "should", "will", "would"]
TEMPORAL = ["before", "after", "during"]

# Intents as (name, required, any of, forbidden, boosts, penalties).
INTENTS = [
    ("question", [], ["has_question_mark", "has_wh", "has_explain"], [], ["has_wh", "has_what", "has_question_mark"], ["has_then"]),
    ("rule", ["has_if"], [], ["has_question_mark"], ["has_then", "has_comma"], ["has_wh"]),
    ("statement", [], [], ["has_question_mark", "has_if"], ["has_aux"], ["has_wh"]),
    ("conditional_question", ["has_if"], ["has_question_mark", "has_wh"], [], ["has_conditional"], []),
]

# Surface patterns (regex with subject and object), predicate, priority by order.
SURFACE = [
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) next to (?:the |a |an )?([\w ]+?)\.?$", "nextTo"),
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) (?:in|inside) (?:the |a |an )?([\w ]+?)\.?$", "in"),
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) at (?:the |a |an )?([\w ]+?)\.?$", "at"),
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) with (?:the |a |an )?([\w ]+?)\.?$", "with"),
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) (holding|carrying|wearing) (?:the |a |an )?([\w ]+?)\.?$", "verb"),
    (r"^(?:the |a |an )?([\w ]+?) (?:is|are) (?:a|an) ([\w ]+?)\.?$", "rdf:type"),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9' ]", " "), " +"), lambda w: w != "")


def features(text: Column) -> Column:
    """Names of the features that a text has, in a fixed order."""
    low, own = F.lower(F.coalesce(text, F.lit(""))), words(text)
    any_of = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    flags = [("has_question_mark", low.contains("?")), ("has_if", any_of(["if"])), ("has_then", any_of(["then"])), ("has_comma", low.contains(",")), ("has_wh", any_of(WH))]
    flags += [(f"has_{w}", any_of([w])) for w in WH]
    flags += [(f"has_{w}", any_of([w])) for w in TEMPORAL]
    flags += [("has_aux", any_of(AUX)), ("has_modal", any_of(MODAL)), ("has_explain", any_of(["explain"])), ("has_conditional", any_of(["if", "unless", "when"]))]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))


def intents(df: DataFrame, key: str, own: str = "features") -> DataFrame:
    """(key, intent, score): the best intent of each row; 0.6 + 0.08 per boost - 0.08 per penalty, within 0..1."""
    rows = [(i, *x) for i, x in enumerate(INTENTS)]
    table = df.sparkSession.createDataFrame(rows, "no int, intent string, req array<string>, any array<string>, ban array<string>, boost array<string>, penalty array<string>")
    met = df.crossJoin(F.broadcast(table))  # four rows
    ok = (F.size(F.array_except("req", own)) == 0) & ((F.size("any") == 0) | F.arrays_overlap("any", F.col(own))) & ~F.arrays_overlap("ban", F.col(own))
    score = exprs.clamp(0.6 + 0.08 * F.size(F.array_intersect("boost", own)) - 0.08 * F.size(F.array_intersect("penalty", own)))
    best = met.filter(F.coalesce(ok, F.lit(False))).withColumn("score", F.round(score, 6))
    return best.groupBy(key).agg(F.max_by(F.struct("intent", "score"), F.struct("score", (-F.col("no")).alias("n"))).alias("x")).select(key, "x.intent", "x.score")


def goal_from_words(text: Column) -> Column:
    """(predicate, expected): the last word in ed, ing or s is the predicate, the word after the wh-word the type."""
    own = words(text)
    verbs = F.filter(own, lambda w: w.rlike("(ed|ing|s)$") & (F.length(w) > 3))
    at = F.transform(own, lambda w, i: F.when(w.isin(WH), i))
    first = F.array_min(F.array_compact(at))
    return F.struct(F.when(F.size(verbs) > 0, exprs.verb_stem(F.element_at(verbs, -1))).alias("predicate"), F.get(own, first + 1).alias("expected"))


def routing(text: Column) -> Column:
    own = words(text)
    any_of = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    return F.when(any_of(TEMPORAL), "TEMPORAL_MATCH").when(any_of(["why", "explain", "cause", "causes"]), "CAUSE_CHAIN").otherwise("RELATION_MATCH")


def surface_facts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, s, p, o): the first surface pattern that fits; confidence 0.9."""
    low = F.lower(F.trim(text))
    found = F.lit(None).cast("struct<s:string,p:string,o:string>")
    for pattern, predicate in reversed(SURFACE):
        part = lambda i, p=pattern: exprs.normal_token(F.regexp_extract(low, p, i))
        verb = F.element_at(F.create_map(*map(F.lit, ["holding", "hold", "carrying", "carry", "wearing", "wear"])), F.regexp_extract(low, pattern, 2)) if predicate == "verb" else F.lit(predicate)
        namespace = "concept:" if predicate == "rdf:type" else "entity:"
        found = F.when(low.rlike(pattern), F.struct(F.concat(F.lit("entity:"), part(1)).alias("s"), verb.alias("p"), F.concat(F.lit(namespace), part(3 if predicate == "verb" else 2)).alias("o"))).otherwise(found)
    return df.select(key, found.alias("f")).filter("f IS NOT NULL").select(key, "f.*", F.lit(0.9).alias("conf"))


def negated_facts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, s, p, o): cannot, can't: the verb is false; cannot be controlled: control is false."""
    low = F.lower(F.trim(text))
    pattern = r"^(?:the |a |an )?([\w ]+?) (?:cannot|can't|can not) (be )?(\w+)"
    verb = F.regexp_extract(low, pattern, 3)
    p = F.when((F.regexp_extract(low, pattern, 2) != "") & verb.startswith("control"), "control").otherwise(exprs.verb_stem(verb))
    return df.filter(low.rlike(pattern)).select(key, F.concat(F.lit("entity:"), exprs.normal_token(F.regexp_extract(low, pattern, 1))).alias("s"), p.alias("p"), F.lit("concept:false").alias("o"))


def conditionals(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ant, con): clauses of "if A then B", "if A, B" and "B if A"."""
    low = F.lower(F.regexp_replace(F.trim(text), r"\.$", ""))
    forms = [(r"^if (.+?),? then (.+)$", 1, 2), (r"^if (.+?), (.+)$", 1, 2), (r"^(.+?) if (.+)$", 2, 1)]
    found = F.lit(None).cast("struct<ant:string,con:string>")
    for pattern, a, c in reversed(forms):
        found = F.when(low.rlike(pattern), F.struct(F.regexp_extract(low, pattern, a).alias("ant"), F.regexp_extract(low, pattern, c).alias("con"))).otherwise(found)
    return df.select(key, found.alias("r")).filter("r IS NOT NULL").select(key, "r.*")


def canonical(facts: DataFrame) -> DataFrame:
    """Canonical predicates: stopped verbs become `fail true`, working verbs with false too, use of backups and controls."""
    p, o = F.lower("p"), F.lower("o")
    stopped = p.startswith("stop") & (o.startswith("concept:") | o.rlike("responding|functioning|working|operating"))
    failing = p.isin("operate", "function", "work", "respond") & o.rlike("^(concept:)?(false|not|no)$")
    used = p.isin("use", "used")
    new_p = F.when(stopped | failing, "fail").when(used & o.contains("backup"), "backupFor").when(used & o.contains("control"), "control").otherwise(F.col("p"))
    return facts.withColumns({"p": new_p, "o": F.when(stopped | failing, "concept:true").otherwise(F.col("o"))})


def expanded(facts: DataFrame) -> DataFrame:
    """`loss_of_x cause y` also means `x fail true`, with x as the cause; `control false` also means `fail true`."""
    lost = F.col("s").startswith("entity:loss_of_") & F.col("p").isin("cause", "causedBy")
    subject = F.when(lost, F.concat(F.lit("entity:"), F.regexp_replace("s", "^entity:loss_of_", ""))).otherwise(F.col("s"))
    extra = F.when(lost | (F.col("p") == "control") & (F.col("o") == "concept:false"), F.struct(subject.alias("s"), F.lit("fail").alias("p"), F.lit("concept:true").alias("o"), F.lit(0.8).alias("conf")))
    main = F.struct(subject.alias("s"), F.col("p"), F.col("o"), F.col("conf"))
    return facts.select(F.explode(F.array_compact(F.array(main, extra))).alias("f")).select("f.*")


def flattened(batches: DataFrame) -> DataFrame:
    """The primary facts `main` (struct) and the facts of `extras` (array; null: none) as rows."""
    return batches.select(F.explode(F.concat(F.array("main"), F.coalesce("extras", F.array()))).alias("f")).select("f.*")


def dual(facts: DataFrame, iris: DataFrame) -> DataFrame:
    """Facts as they were said (kind surface), and once more under their predicate's IRI (p, iri) where it has one (canonical)."""
    canonical = facts.join(iris, "p").withColumn("p", F.col("iri")).select(*facts.columns, F.lit("canonical").alias("kind"))
    return canonical.unionByName(facts.withColumn("kind", F.lit("surface")))


def conjoined(facts: DataFrame) -> DataFrame:
    """entity:a_and_b is two subjects."""
    names = F.split(F.regexp_replace("s", "^entity:", ""), "_and_")
    return facts.withColumn("s", F.explode(F.transform(names, lambda n: F.concat(F.lit("entity:"), n))))


def vocabulary_predicate(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, predicate): the first word whose stem is a known predicate."""
    each = df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).withColumn("predicate", exprs.verb_stem(F.col("word")))
    return each.join(vocabulary, "predicate", "left_semi").groupBy(key).agg(F.min_by("predicate", "pos").alias("predicate"))


def best_parse(df: DataFrame, key: str) -> DataFrame:
    """Of competing goals (key, source, goal, score), the highest score; `language` before `parser` on ties."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.when(F.col("source") == "language", 0).otherwise(1), "goal")
    return df.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def clause(s: Column, p: Column, o: Column, template: Column) -> Column:
    """A sentence from a template (`verb:..;voice:passive;prep:..`) or from the predicate itself."""
    parts = exprs.template_parts(F.coalesce(template, F.lit("verb:")))
    verb = F.when(F.coalesce(parts["verb"], F.lit("")) != "", parts["verb"]).otherwise(exprs.display(p))
    said = F.when(parts["voice"] == "passive", F.concat_ws(" ", F.lit("is"), verb, F.coalesce(parts["prep"], F.lit("by")))).otherwise(F.concat_ws(" ", verb, parts["prep"]))
    flag = exprs.boolean_concept(o)
    body = F.when(flag, said).when(flag == False, F.concat(F.lit("does not "), said)).otherwise(F.concat_ws(" ", said, exprs.display(o)))  # noqa: E712
    return F.concat(F.lit("The "), exprs.display(s), F.lit(" "), body, F.lit("."))
