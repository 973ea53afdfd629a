"""Text jobs, linking, vectors and quality checks; texts are those of the tables or made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import linking, store, text
from ..sources import facts
from ..sources.facts import Tables
from . import answer_queries
from .register import Register
from .store_queries import CASES_SQL, case_lines

query = Register()


def utterances(t: Tables):
    """(id, text): a question, a rule or a statement about every customer."""
    c, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    said = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Where is customer "), c, F.lit("?")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("If customer "), c, F.lit(" pays, then nation "), n, F.lit(" profits.")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("The customer "), c, F.lit(" is in nation "), n, F.lit(".")))
        .otherwise(F.concat(F.lit("The customer "), c, F.lit(" cannot be controlled before nation "), n, F.lit(".")))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), said.alias("text"))


UTTER = """u AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey AS c, c_nationkey AS n FROM customer)"""


@query(
    "utterance_features",
    f"WITH {UTTER} SELECT CASE k WHEN 0 THEN 'has_question_mark,has_wh,has_where,has_aux' WHEN 1 THEN 'has_if,has_then,has_comma,has_conditional' WHEN 2 THEN 'has_aux' ELSE 'has_before' END AS features, count(*) AS n FROM u GROUP BY 1",
)
def utterance_features(t: Tables):
    return utterances(t).select(F.array_join(text.features(F.col("text")), ",").alias("features")).groupBy("features").agg(F.count("*").alias("n"))


@query("text_features", "SELECT role, count(*) AS n, count(*) FILTER (WHERE contains(text, '?')) AS questions, count(*) FILTER (WHERE contains(text, ',')) AS commas FROM conversations GROUP BY 1")
def text_features(t: Tables):
    own = t.conversations.select("role", text.features(F.col("text")).alias("f"))
    return own.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(F.array_contains("f", "has_question_mark"), 1)).alias("questions"), F.count(F.when(F.array_contains("f", "has_comma"), 1)).alias("commas"))


@query("intent", f"WITH {UTTER} SELECT id, CASE k WHEN 0 THEN 'question' WHEN 1 THEN 'rule' ELSE 'statement' END AS intent, CASE k WHEN 0 THEN 0.76 WHEN 1 THEN 0.76 WHEN 2 THEN 0.68 ELSE 0.6 END::DOUBLE AS score FROM u")
def intent(t: Tables):
    own = utterances(t).select("id", text.features(F.col("text")).alias("features"))
    return text.intents(own, "id")


@query("goal_proposal", "SELECT p_partkey AS id, 'contain' AS predicate, split_part(p_name, ' ', 1) AS expected FROM part")
def goal_proposal(t: Tables):
    """"What small ring contains steel": the verb is the predicate, the word after the wh-word the type."""
    said = F.concat(F.lit("What "), F.col("p_name"), F.lit(" contains steel?"))
    return t.part.select(F.col("p_partkey").alias("id"), text.goal_from_words(said).alias("g")).select("id", "g.predicate", "g.expected")


@query("question_shape", "SELECT s_suppkey AS id, 'with' AS prep, 'supplier_' || s_suppkey AS object, swapped, CASE WHEN swapped THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS score FROM supplier, (VALUES (TRUE), (FALSE)) v(swapped)")
def question_shape(t: Tables):
    """"Who is with supplier_1?": a goal, and for "with" the swapped one."""
    said = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Who is with supplier_"), F.col("s_suppkey").cast("string"), F.lit("?")).alias("text"))
    pattern = r"^(?:who|what) (?:is|are) (in|on|at|with|under|near) (\S+?)\?$"
    low = F.lower("text")
    both = F.when(F.regexp_extract(low, pattern, 1) == "with", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return said.filter(low.rlike(pattern)).select("id", F.regexp_extract(low, pattern, 1).alias("prep"), F.regexp_extract(low, pattern, 2).alias("object"), F.explode(both).alias("swapped")).withColumn("score", F.when(F.col("swapped"), 0.25).otherwise(0.35))


@query("simple_goals", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'COUNT' WHEN 1 THEN 'ATTRIBUTE' ELSE 'WHERE' END AS gtype, CASE p_partkey % 3 WHEN 0 THEN 'suppliers' WHEN 1 THEN 'size' ELSE 'part_' || p_partkey END AS subject FROM part")
def simple_goals(t: Tables):
    """"How many T in O", "What X is Y", "Where is Y"."""
    k = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("How many suppliers in part_"), k, F.lit("?"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("What size is part_"), k, F.lit("?"))).otherwise(F.concat(F.lit("Where is part_"), k, F.lit("?")))
    low = F.lower(said)
    forms = [("COUNT", r"^how many (\w+) (?:in|with|is|are)"), ("ATTRIBUTE", r"^what (\w+) is "), ("WHERE", r"^where (?:is|are) (\w+)")]
    goal = F.lit(None).cast("struct<gtype:string,subject:string>")
    for gtype, pattern in reversed(forms):
        goal = F.when(low.rlike(pattern), F.struct(F.lit(gtype).alias("gtype"), F.regexp_extract(low, pattern, 1).alias("subject"))).otherwise(goal)
    return t.part.select(F.col("p_partkey").alias("id"), goal.alias("g")).select("id", "g.*")


@query("routing", f"WITH {UTTER} SELECT CASE WHEN k = 3 THEN 'TEMPORAL_MATCH' ELSE 'RELATION_MATCH' END AS route, count(*) AS n FROM u GROUP BY 1")
def routing(t: Tables):
    return utterances(t).select(text.routing(F.col("text")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("vocab_predicate", "SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'purchas' WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' END AS predicate FROM events WHERE event_type IN ('purchase', 'click', 'view')")
def vocab_predicate(t: Tables):
    """"user 7 clicked 12": the first word whose stem is a known event."""
    past = F.when(F.col("event_type") == "purchase", "purchased").when(F.col("event_type") == "click", "clicked").when(F.col("event_type") == "view", "viewed").otherwise(F.col("event_type"))
    said = t.events.select(F.col("event_id").alias("id"), F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), past, F.col("event_id").cast("string")).alias("text"))
    known = t.events.filter("event_type IN ('purchase', 'click', 'view')").select(F.regexp_replace("event_type", "e$", "").alias("predicate")).distinct()
    known = known.withColumn("predicate", F.when(F.col("predicate") == "purchas", "purchas").otherwise(F.col("predicate")))
    return text.vocabulary_predicate(said, "id", "text", known)


@query("phrase_override", f"WITH {UTTER} SELECT id, CASE k WHEN 0 THEN 'relationship' WHEN 1 THEN 'condition' WHEN 3 THEN 'prevent' ELSE 'none' END AS override FROM u")
def phrase_override(t: Tables):
    """Wording that overrides a goal's predicate."""
    low = F.lower("text")
    rules = F.when(low.rlike("^where"), "relationship").when(low.rlike(r"\bif\b"), "condition").when(low.rlike(r"\b(cannot|can't|prevent)\b"), "prevent").otherwise("none")
    return utterances(t).select("id", rules.alias("override"))


@query("parse_competition", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 'parser' ELSE 'language' END AS source FROM orders")
def parse_competition(t: Tables):
    """Two readings of every order's text; the higher score wins, the language source on ties."""
    k = F.col("o_orderkey") % 3
    one = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("language").alias("source"), F.lit("a").alias("goal"), F.when(k == 0, 0.5).when(k == 1, 0.4).otherwise(0.3).alias("score"))
    two = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("parser").alias("source"), F.lit("b").alias("goal"), F.lit(0.4).alias("score"))
    return text.best_parse(one.unionByName(two), "id").select("id", "source")


@query("surface_facts", f"WITH {UTTER} SELECT id, 'entity:customer_' || c AS s, 'in' AS p, 'entity:nation_' || n AS o FROM u WHERE k = 2")
def surface_facts(t: Tables):
    return text.surface_facts(utterances(t), "id").select("id", "s", "p", "o")


@query("negated_facts", f"WITH {UTTER} SELECT id, 'entity:customer_' || c AS s, 'control' AS p, 'concept:false' AS o FROM u WHERE k = 3")
def negated_facts(t: Tables):
    return text.negated_facts(utterances(t), "id")


@query("conditional_rules", f"WITH {UTTER} SELECT id, 'customer ' || c || ' pays' AS ant, 'nation ' || n || ' profits' AS con FROM u WHERE k = 1")
def conditional_rules(t: Tables):
    return text.conditionals(utterances(t), "id")


CANON = """WITH f AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'stopped' WHEN 'view' THEN 'operate' WHEN 'click' THEN 'use' ELSE 'touch' END AS p, CASE event_type WHEN 'error' THEN 'concept:responding' WHEN 'view' THEN CASE WHEN value < 50 THEN 'concept:false' ELSE 'concept:true' END WHEN 'click' THEN CASE WHEN value < 50 THEN 'entity:backup_bus' ELSE 'entity:control_unit' END ELSE 'entity:x' END AS o FROM events)
SELECT CASE WHEN p = 'stopped' OR p = 'operate' AND o = 'concept:false' THEN 'fail' WHEN o = 'entity:backup_bus' THEN 'backupFor' WHEN o = 'entity:control_unit' THEN 'control' ELSE p END AS p, CASE WHEN p = 'stopped' OR p = 'operate' AND o = 'concept:false' THEN 'concept:true' ELSE o END AS o, count(*) AS n FROM f GROUP BY 1, 2"""


@query("canonical_facts", CANON)
def canonical_facts(t: Tables):
    low = F.col("value") < 50
    p = F.when(F.col("event_type") == "error", "stopped").when(F.col("event_type") == "view", "operate").when(F.col("event_type") == "click", "use").otherwise("touch")
    o = F.when(F.col("event_type") == "error", "concept:responding").when(F.col("event_type") == "view", F.when(low, "concept:false").otherwise("concept:true")).when(F.col("event_type") == "click", F.when(low, "entity:backup_bus").otherwise("entity:control_unit")).otherwise("entity:x")
    own = t.events.select(facts.event_symbol(F.col("event_id")).alias("s"), p.alias("p"), o.alias("o"))
    return text.canonical(own).groupBy("p", "o").agg(F.count("*").alias("n"))


@query("expanded_facts", "SELECT p, count(*) AS n FROM (SELECT 'cause' AS p FROM events WHERE event_type = 'error' UNION ALL SELECT 'control' FROM events WHERE event_type = 'view' UNION ALL SELECT 'fail' FROM events WHERE event_type IN ('error', 'view')) GROUP BY 1")
def expanded_facts(t: Tables):
    error = F.col("event_type") == "error"
    own = t.events.filter("event_type IN ('error', 'view')").select(
        F.when(error, F.concat(F.lit("entity:loss_of_"), F.col("event_id").cast("string"))).otherwise(facts.event_symbol(F.col("event_id"))).alias("s"),
        F.when(error, "cause").otherwise("control").alias("p"), F.when(error, F.lit("entity:x")).otherwise("concept:false").alias("o"), F.lit(0.9).alias("conf"),
    )
    return text.expanded(own).groupBy("p").agg(F.count("*").alias("n"))


@query("conjoined_subjects", "SELECT 'entity:part_' || p AS s, count(*) AS n FROM (SELECT l_partkey AS p FROM lineitem UNION ALL SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1")
def conjoined_subjects(t: Tables):
    """First lines name their part twice ("a and a")."""
    name = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    own = t.lineitem.select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("entity:"), name, F.lit("_and_"), name)).otherwise(F.concat(F.lit("entity:"), name)).alias("s"))
    return text.conjoined(own).groupBy("s").agg(F.count("*").alias("n"))


@query(
    "statement_batch",
    """WITH f AS (SELECT 'placedBy' AS p, o_orderkey AS s, o_custkey AS o FROM orders UNION ALL SELECT DISTINCT 'requires', l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p, 'surface' AS kind, count(*) AS n, sum(s + o)::BIGINT AS keys FROM f GROUP BY 1 UNION ALL SELECT 'http://a.example/requires', 'canonical', count(*), sum(s + o)::BIGINT FROM f WHERE p = 'requires'""",
)
def statement_batch(t: Tables):
    """Who placed an order, with the parts that it requires as extras, flattened; predicates with an IRI are emitted twice."""
    s = facts.symbol("order", F.col("o_orderkey")).alias("s")
    extra = F.struct(s, F.lit("requires").alias("p"), facts.symbol("part", F.col("l_partkey")).alias("o"))
    extras = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").groupBy("o_orderkey").agg(F.collect_set(extra).alias("extras"))
    main = F.struct(s, F.lit("placedBy").alias("p"), facts.symbol("customer", F.col("o_custkey")).alias("o"))
    batches = t.orders.join(extras, "o_orderkey", "left").select(main.alias("main"), "extras")
    iris = t.spark.createDataFrame([("requires", "http://a.example/requires")], "p string, iri string")
    key = lambda c: F.regexp_extract(c, r"_(\d+)$", 1).cast("long")
    return text.dual(text.flattened(batches), iris).groupBy("p", "kind").agg(F.count("*").alias("n"), F.sum(key("s") + key("o")).alias("keys"))


@query("render_facts", "SELECT l_partkey AS part, count(DISTINCT 'The part ' || l_partkey || ' is with supplier ' || l_suppkey || '.') AS n, min('The part ' || l_partkey || ' is with supplier ' || l_suppkey || '.') AS first FROM lineitem GROUP BY 1")
def render_facts(t: Tables):
    own = facts.part_with_supplier(t).select((F.col("seq") / 1_000_000).cast("long").alias("part"), text.clause(F.col("s"), F.col("p"), F.col("o"), F.lit("verb:is with")).alias("line"))
    return own.groupBy("part").agg(F.count_distinct("line").alias("n"), F.min("line").alias("first"))


@query("render_answers", "SELECT p_partkey AS id, CASE WHEN n = 1 THEN 'The supplier is ' || a || '.' ELSE 'The suppliers are ' || a || '.' END AS line FROM (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS a FROM lineitem GROUP BY 1)")
def render_answers(t: Tables):
    """One or many answers with the label of the expected type."""
    own = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("a"))
    label = F.lit("supplier")
    one = F.size("a") == 1
    return own.select("id", F.concat(F.lit("The "), F.when(one, label).otherwise(exprs.plural(label)), F.when(one, " is ").otherwise(" are "), F.array_join("a", ", "), F.lit(".")).alias("line"))


@query("phrase_linking", "SELECT DISTINCT p_name AS phrase, 'entity:' || replace(p_name, ' ', '_') AS symbol FROM part")
def phrase_linking(t: Tables):
    known = t.part.select(facts.named(F.col("p_name")).alias("symbol")).distinct()
    return linking.exact(t.part.select(F.col("p_name").alias("phrase")).distinct(), known)


@query("token_linking", "SELECT p_partkey AS key, 'entity:' || replace(p_name, ' ', '_') AS symbol FROM part")
def token_linking(t: Tables):
    """"order of small ring today" finds the name by its tokens."""
    known = t.part.select(facts.named(F.col("p_name")).alias("symbol")).distinct()
    said = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("order of "), "p_name", F.lit(" today")).alias("text"))
    return linking.by_tokens(said, known)


@query("scored_linking", "SELECT DISTINCT p_name || 's' AS phrase, 'entity:' || replace(p_name, ' ', '_') AS symbol, 2.2::DOUBLE AS score FROM part")
def scored_linking(t: Tables):
    """Plural phrases: singular-equal 1.6 and singular contains 0.6."""
    known = t.part.select(facts.named(F.col("p_name")).alias("symbol")).distinct()
    return linking.scored(t.part.select(F.concat("p_name", F.lit("s")).alias("phrase")).distinct(), known)


@query("label_linking", "SELECT p_partkey AS key, 'http://b.example/thing/' || replace(p_name, ' ', '-') AS iri FROM part")
def label_linking(t: Tables):
    """A phrase to an IRI by the label's search form."""
    names = t.part.select(F.concat(F.lit("http://b.example/thing/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("iri"), exprs.normal_search(F.upper("p_name")).alias("form")).distinct()
    return t.part.select(F.col("p_partkey").alias("key"), exprs.normal_search(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("form")).join(names, "form").select("key", "iri")


@query("mention_extraction", "SELECT l_partkey AS key, count(DISTINCT n_name) AS n, min('entity:' || lower(n_name)) AS first FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def mention_extraction(t: Tables):
    """"NATION_0, NATION_5 and NATION_7": every nation that a part comes from is found again."""
    from_ = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    listed = facts.pairs(t).join(from_, "l_suppkey").groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_set("n_name")).alias("a"))
    said = listed.select("key", F.concat(F.array_join(F.slice("a", 1, F.size("a") - 1), ", "), F.lit(" and "), F.element_at("a", -1)).alias("text"))
    known = t.nation.select(facts.named(F.col("n_name")).alias("symbol"))
    return linking.mentions(said, known).groupBy("key").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("first"))


@query("ngram_tagging", "SELECT p_partkey AS key, p_name AS term, 2 AS start FROM part")
def ngram_tagging(t: Tables):
    """Names are tagged whole, not by their nouns, which are terms too."""
    terms = t.part.select(F.col("p_name").alias("term")).union(t.part.select(F.split("p_name", " ")[1])).distinct()
    said = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("an order: "), "p_name", F.lit(" today")).alias("text"))
    return linking.ngram_tags(said, terms).select("key", "term", "start")


@query(
    "document_terms",
    r"""WITH terms AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM benchmark)),
  ws AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) SELECT doc_id AS key, count(*) AS n FROM ws JOIN terms ON w = term GROUP BY 1""",
)
def document_terms(t: Tables):
    """Words of documents that are words of the benchmark, by postings."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    terms = t.benchmark.select(F.explode(words("text")).alias("term")).distinct()
    each = t.documents.select(F.col("doc_id").alias("key"), F.explode(words("text")).alias("term"))
    return each.join(terms, "term").groupBy("key").agg(F.count("*").alias("n"))


@query("nearest_marker", "SELECT p_partkey AS key, 'unavailable' AS marker, split_part(p_name, ' ', 2) AS resource, 2 AS distance FROM part")
def nearest_marker(t: Tables):
    """"the ring is unavailable but other widgets remain": the marker goes to the nearer resource."""
    noun = F.split("p_name", " ")[1]
    said = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("the "), noun, F.lit(" is unavailable but every other part of our many "), noun, F.lit(" remains")).alias("text"))
    markers = t.spark.createDataFrame([("available",), ("unavailable",)], "term string")
    return linking.nearest_marker(said, t.part.select(noun.alias("term")), markers).select("key", "marker", "resource", "distance")


HASHED = """v AS (SELECT label, slot, sum(sgn) AS w FROM (SELECT label, (961 * ascii(substr(f, i, 1)) + 31 * ascii(substr(f, i + 1, 1)) + ascii(substr(f, i + 2, 1))) % 256 AS slot, CASE WHEN (961 * ascii(substr(f, i, 1)) + 31 * ascii(substr(f, i + 1, 1)) + ascii(substr(f, i + 2, 1))) % 2 = 0 THEN 1 ELSE -1 END AS sgn
  FROM (SELECT label, f, unnest(range(1, length(f) - 1)) AS i FROM (SELECT DISTINCT p_name AS label, replace(p_name, ' ', '_') AS f FROM part))) GROUP BY 1, 2),
  h AS (SELECT label, slot, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM v WHERE w <> 0)"""


@query("hashed_vectors", f"WITH {HASHED} SELECT label, CAST(slot AS INT) AS slot, round(w, 6) AS w FROM h")
def hashed_vectors(t: Tables):
    return linking.hashed_vectors(t.part.select(F.col("p_name").alias("label")).distinct()).select("label", "slot", F.round("w", 6).alias("w"))


@query("vector_nearest", f"WITH {HASHED} SELECT a.label AS query, a.label AS label FROM (SELECT DISTINCT label FROM h) a")
def vector_nearest(t: Tables):
    """The nearest label of each name's upper-case form is the name."""
    names = t.part.select(F.col("p_name").alias("label")).distinct()
    got = linking.nearest_label(names.select(F.upper("label").alias("query")), linking.hashed_vectors(names))
    return got.select(F.lower("query").alias("query"), "label")


CENTRE = """e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS slot, unnest(embedding)::DOUBLE AS v FROM embeddings),
  c AS (SELECT label, slot, sum(v) AS v FROM e GROUP BY 1, 2), n AS (SELECT label, slot, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS value FROM c)"""


@query("label_centroids", f"WITH {CENTRE} SELECT label, CAST(slot AS INT) AS slot, round(value, 6) AS value FROM n")
def label_centroids(t: Tables):
    own = linking.centroids(t.embeddings.withColumn("one", F.lit(1.0)), "label", "embedding", "one")
    return own.select("label", "slot", F.round("value", 6).alias("value"))


@query(
    "nearest_centroid",
    f"WITH {CENTRE}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM e GROUP BY 1), d AS (SELECT vec_id, n.label, sum(e.v / size * value) AS score FROM e JOIN s USING (vec_id) JOIN n ON n.slot = e.slot GROUP BY 1, 2) SELECT vec_id, arg_max(label, score) AS label FROM d GROUP BY 1",
)
def nearest_centroid(t: Tables):
    centres = linking.centroids(t.embeddings.withColumn("one", F.lit(1.0)), "label", "embedding", "one")
    return linking.nearest_centroid(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", centres, "label").select("vec_id", "label")


@query(
    "user_vectorizer",
    f"WITH {CENTRE}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM e GROUP BY 1), d AS (SELECT vec_id, n.label, round(sum(e.v / size * value), 9) AS score FROM e JOIN s USING (vec_id) JOIN n ON n.slot = e.slot GROUP BY 1, 2) SELECT CAST(vec_id AS VARCHAR) AS query, arg_max(label, (score, label)) AS label, round(max(score), 6) AS score FROM d WHERE score >= 0.2 GROUP BY 1",
)
def user_vectorizer(t: Tables):
    """Vectors given as a table take the place of the hashed ones: the nearest label centre of each id."""
    given = linking.unit_vectors(t.embeddings.select(F.col("vec_id").cast("string").alias("label"), "embedding"), "embedding")
    centres = linking.centroids(t.embeddings.withColumn("one", F.lit(1.0)), "label", "embedding", "one").select("label", "slot", F.col("value").alias("w"))
    ids = t.embeddings.select(F.col("vec_id").cast("string").alias("query"))
    got = linking.exact_nearest_label(ids, centres, least=0.2, vectorizer=lambda df: given.join(df, "label", "left_semi"))
    return got.select("query", "label", F.round("score", 6).alias("score"))


@query("annotation_conflicts", "SELECT p_brand AS iri, p_name AS annotation, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def annotation_conflicts(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("iri"), F.col("p_name").alias("annotation")).agg(F.count_distinct("p_size").alias("n")).filter("n > 1")


@query("alias_collisions", "SELECT replace(p_name, ' ', '_') AS token, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def alias_collisions(t: Tables):
    return t.part.groupBy(exprs.normal_token(F.col("p_name")).alias("token")).agg(F.count_distinct("p_partkey").alias("n")).filter("n > 1")


@query("invalid_annotations", "SELECT event_type AS annotation, count(*) AS n, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS bad FROM events GROUP BY 1")
def invalid_annotations(t: Tables):
    """Weights that are no numbers."""
    own = t.events.select("event_type", F.get_json_object("props", "$.k").alias("value"))
    return own.groupBy(F.col("event_type").alias("annotation")).agg(F.count("*").alias("n"), F.count(F.when(F.expr("try_cast(value AS double)").isNull(), 1)).alias("bad"))


@query(
    "answer_eval",
    f"""WITH {CASES_SQL}, best AS ({answer_queries.ORACLES["best_answer"]}),
  e AS (SELECT p_brand AS brand, file, n, bool_and(contains('the part ' || n || ' is with supplier ' || substr(answer, 17) || '.', w)) AS ok
    FROM cases JOIN part ON n = p_partkey LEFT JOIN best ON goal_id = n, unnest(string_split(replace(expected, '|', ' '), ' ')) AS x(w) GROUP BY 1, 2, 3)
SELECT brand, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e GROUP BY 1""",
)
def answer_eval(t: Tables):
    """The best answers to "which suppliers is part P with?" against the suppliers that each order has the part from, by brand."""
    cases = store.cases(case_lines(t)).join(t.part.select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("brand")), "n")
    said = text.clause(facts.symbol("part", F.col("goal_id")), F.lit("with"), F.col("answer"), F.lit("verb:is with"))
    best = answer_queries.best_answer(t).select(F.col("goal_id").alias("n"), said.alias("answer"))
    got = store.evaluated(cases.join(best, "n", "left"))
    return got.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))


QUERIES, ORACLES = query.queries, query.oracles
