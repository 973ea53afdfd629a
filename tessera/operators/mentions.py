"""Known phrases in texts, what a question mentions, facts between mentions, states of resources, predicates from wording."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs
from . import linking
from .ontology import alias_keys, cut
from .rules import packed, unpacked
from .text import words

#: Phrases, and characters of them, that one automaton may hold; more are looked up by a join.
MOST_PHRASES, MOST_CHARACTERS = 100_000, 8 << 20
#: runs of words that a worker gives out at once
RUNS = 20_000


def plain_text(text: Column) -> Column:
    """Lower case, a blank for every run of other than letters and digits, one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def by_automaton(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """(key, phrase, at) by one pass over each text with an automaton of all phrases, built once a worker batch."""
    shared = texts.sparkSession.sparkContext.broadcast(phrases)
    schema = StructType([texts.schema["key"]]).add("phrase", "string").add("at", "long")

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in shared.value:
            automaton.add_word(f" {p} ", p)
        automaton.make_automaton()
        for batch in batches:
            rows, found, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for end, p in automaton.iter(text):
                    rows.append(i)
                    found.append(p)
                    places.append(end - len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], ["key", "phrase", "at"])

    return texts.mapInArrow(run, schema)


def by_words(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase, at) by an equi-join of whole phrases with the texts' runs of as many words.

    A text costs its words once for each number of words that phrases have, however many phrases begin alike; its runs
    are made where the text is, so neither words nor texts are shuffled and sorted for them.
    """
    own = phrases.select("phrase", F.size(F.split("phrase", " ")).alias("length"))
    lengths = sorted(r["length"] for r in own.select("length").distinct().collect())
    schema = StructType([texts.schema["key"]]).add("length", "integer").add("phrase", "string").add("at", "long")

    def run(batches):
        for batch in batches:
            rows, sizes, found, places = [], [], [], []
            made = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.string()), pa.array(places, pa.int64())], ["key", "length", "phrase", "at"])  # noqa: E731,B023
            for i, text in enumerate(batch.column(1).to_pylist()):
                own_words, at = text.split(), 1
                for n, word in enumerate(own_words):
                    for k in lengths:
                        # A run that the text's end would cut off is none.
                        if n + k <= len(own_words):
                            rows.append(i)
                            sizes.append(k)
                            found.append(" ".join(own_words[n : n + k]))
                            places.append(at)
                    at += len(word) + 1
                    if len(rows) >= RUNS:
                        yield made()
                        rows, sizes, found, places = [], [], [], []
            yield made()

    placed = texts.mapInArrow(run, schema)
    # The runs are many more than Spark makes of the size of the texts' file: they are never broadcast.
    return placed.join(own.hint("merge"), ["length", "phrase"]).select("key", "phrase", "at")


def occurrences(texts: DataFrame, phrases: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """(key, phrase, at): where known phrases (phrase) stand as whole words in texts (key, text); `at` counts characters from 1.

    Texts are compared as `plain_text`, phrases likewise; nested and overlapping phrases are all found. Up to `most`
    phrases, counted first, make one automaton that every worker gets; more are joined with the texts' runs of words.
    """
    own = texts.select("key", plain_text(F.col("text")).alias("text"))
    known = cut(phrases.select(F.trim(plain_text(F.col("phrase"))).alias("phrase")).filter("phrase <> ''").distinct())
    few = known.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("characters")).first()
    if few["n"] <= most and few["characters"] <= MOST_CHARACTERS:
        return by_automaton(own, [r["phrase"] for r in known.collect()])
    return by_words(own, known)


def apart(found: DataFrame) -> DataFrame:
    """(key, phrase, first, n) of occurrences: where a phrase stands first, and how often without overlapping itself, from the left."""
    end = (F.length("phrase") + 1).cast("long")
    taken = F.aggregate(
        F.array_sort(F.collect_list("at")), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.when(at >= acc["end"], F.struct((at + end).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    return found.groupBy("key", "phrase").agg(F.min("at").alias("first"), taken["n"].alias("n"))


BETWEEN = ["relationship between", "under what conditions"]


def mentioned(questions: DataFrame, known: DataFrame, keep: int = 4) -> DataFrame:
    """(key, symbol, way): what questions (key, text, subject, object) are about, of known (symbol, surface).

    The goal's own sides (way `side`); the phrases between commas and "and", in questions for a relationship those
    behind "between" (`phrase`), linked exactly, then by tokens, then by score; and where that makes fewer than two, in
    questions for a relationship, the first `keep` known surfaces of four or more characters that stand in the text (`surface`).
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    asks = reduce(lambda a, b: a | b, [low.contains(c) for c in BETWEEN])
    own = questions.select("key", "subject", "object", asks.alias("asks"), low.alias("text"))
    sides = own.select("key", F.explode(F.array_compact(F.array("subject", "object"))).alias("symbol")).filter("trim(symbol) <> ''").withColumn("way", F.lit("side"))
    behind = F.when(F.col("asks") & F.col("text").contains("between"), F.regexp_replace("text", r"^.*?between", "")).otherwise(F.col("text"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(behind, r"\b(relationship|between|the|a|an)\b", " "), r"[?.!]", " "))
    pieces = own.select("key", F.explode(F.split(bare, r"\s*(?:,|\band\b)\s*")).alias("phrase")).select("key", F.regexp_replace(F.trim("phrase"), r"\s+", " ").alias("phrase")).filter("phrase <> ''")
    phrases = cut(pieces.select("phrase").distinct())
    symbols = known.select("symbol").distinct()
    exact = linking.exact(phrases, symbols)
    tokens = linking.by_tokens(phrases.select(F.col("phrase").alias("key"), F.col("phrase").alias("text")), symbols).select(F.col("key").alias("phrase"), F.col("symbol").alias("second"))
    close = linking.scored(phrases, symbols).select("phrase", F.col("symbol").alias("third"))
    linked = pieces.join(exact, "phrase", "left").join(tokens, "phrase", "left").join(close, "phrase", "left").select("key", F.coalesce("symbol", "second", "third").alias("symbol"), F.lit("phrase").alias("way")).filter("symbol IS NOT NULL")
    rank = F.when(F.col("way") == "side", 0).otherwise(1)
    found = cut(sides.unionByName(linked).groupBy("key", "symbol").agg(F.min_by("way", rank).alias("way")))
    poor = own.filter("asks").select("key", "text").join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left").filter("coalesce(n, 0) < 2").select("key", "text")
    surfaces = known.select("symbol", F.trim(plain_text(F.col("surface"))).alias("phrase")).filter(F.length("phrase") >= 4)
    there = occurrences(poor, surfaces.select("phrase")).groupBy("key", "phrase").agg(F.min("at").alias("at")).join(surfaces, "phrase")
    first = there.groupBy("key", "symbol").agg(F.min("at").alias("at")).join(found.select("key", "symbol"), ["key", "symbol"], "left_anti")
    placed = first.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "symbol"))).filter(F.col("n") <= keep)
    return found.unionByName(placed.select("key", "symbol", F.lit("surface").alias("way")))


# Predicates that tell a relationship, with their priority.
RELATIONSHIP = {
    0: ["contain", "contains"], 1: ["control", "use", "used", "act", "actuates"],
    2: ["on", "in", "at", "with", "under", "inside", "near", "beside", "alongside", "next", "next_to", "next-to", "locatedin"], 3: ["type", "rdf:type"],
}


def relationship_priority(predicate: Column) -> Column:
    """0 to 3; null for predicates that tell no relationship."""
    local = exprs.local_name(predicate)
    return reduce(lambda c, kv: c.when(local.isin(kv[1]), kv[0]), RELATIONSHIP.items(), F.when(F.lit(False), F.lit(0)))


def aliases_of(named: DataFrame, known: DataFrame) -> DataFrame:
    """(mention, symbol): known symbols (symbol, name) under one of the keys of a mention's name (mention, name); ids may be of any type."""
    return named.select("mention", F.explode(alias_keys(F.col("name"))).alias("name")).join(known, "name").select("mention", "symbol").distinct()


def mention_facts(mentions: DataFrame, facts: DataFrame, known: DataFrame, keep: int = 5) -> DataFrame:
    """(goal, place, priority, line): the first `keep` facts whose ends are aliases of two different mentions (goal, symbol) of a goal."""
    own = mentions.select("goal", F.col("symbol").alias("mention"))
    named = own.select("mention", F.col("mention").alias("name")).distinct()
    return lines_between(own, aliases_of(named, known.select("symbol", F.col("symbol").alias("name")).distinct()), facts, keep=keep)


#: facts of a subject that a goal's objects are held against
LISTED = 10_000


def lines_between(mentions: DataFrame, aliases: DataFrame, facts: DataFrame, name: Callable[[Column], Column] = lambda x: x, keep: int = 5) -> DataFrame:
    """`mention_facts` of mentions (goal, mention), their aliases (mention, symbol) and facts (s, p, o, seq), with ids of any type, of which `name` makes symbols.

    Only aliases that are ends of such facts count. A goal asks each subject among them for all objects of its other mentions at
    once, so there is no row per pair; where a subject has more than LISTED facts, pairs are looked up.
    """
    told = facts.withColumn("priority", relationship_priority(F.col("p"))).filter("priority IS NOT NULL").select("s", "o", "p", "priority", "seq")
    end = lambda name, first: F.struct(F.col(name).alias("symbol"), F.lit(first).alias("first"))
    ends = told.select(F.explode(F.array(end("s", True), end("o", False))).alias("x")).groupBy("x.symbol").agg(F.count_if("x.first").alias("n"), F.bool_or(~F.col("x.first")).alias("second"))
    marked = cut(aliases.join(ends, "symbol").select("mention", "symbol", "n", "second"))
    most = marked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    # What is shuffled: 1 for a subject, 2 for an object, 3 for both, and no mention where it is its own alias.
    side = (F.when(F.col("n") > 0, 1).otherwise(0) + F.when(F.col("second"), 2).otherwise(0)).cast("tinyint")
    same = dict(marked.dtypes)["mention"] == dict(marked.dtypes)["symbol"]
    alias = mentions.join(marked.select("mention", "symbol", side.alias("side")), "mention").select("goal", F.when(F.col("mention") != F.col("symbol"), F.col("mention")).alias("mention") if same else "mention", "symbol", "side").repartition("goal")
    goals = alias.groupBy("goal").agg(F.collect_set(F.struct(F.coalesce("mention", "symbol").alias("mention") if same else "mention", "symbol", "side")).alias("all"))
    each = goals.select("goal", "all", F.explode(F.filter("all", lambda x: x["side"] != 2)).alias("x"))
    others = F.filter("all", lambda y: (y["side"] != 1) & (y["mention"] != F.col("x.mention")))
    asked = each.select("goal", F.col("x.symbol").alias("s"), F.array_distinct(F.transform(others, lambda y: y["symbol"])).alias("os")).filter(F.size("os") > 0)
    by, lines = ("s",) if most <= LISTED else ("s", "o"), ["s", "o", "p", "priority"]
    there = told.repartition(*by).groupBy(*lines).agg(F.min("seq").alias("seq")).hint("merge")
    if most <= LISTED:
        longs = dict(asked.dtypes)["os"] == "array<bigint>"
        asked = asked.withColumn("os", packed(F.sort_array("os")) if longs else F.col("os")).repartition("s").withColumn("os", unpacked(F.col("os")) if longs else F.col("os"))
        met = asked.join(there, "s").filter(F.array_contains("os", F.col("o")))
    else:
        met = asked.select("goal", "s", F.explode("os").alias("o")).join(there, ["s", "o"])
    order = Window.partitionBy("goal").orderBy("priority", "seq", "line")
    found = met.select("goal", *lines, "seq").repartition("goal").select("goal", F.concat_ws(" ", name(F.col("s")), "p", name(F.col("o"))).alias("line"), "priority", "seq").distinct()
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("goal", "place", "priority", "line")


def nearest_states(texts: DataFrame, resources: DataFrame, markers: DataFrame) -> DataFrame:
    """(key, resource, status, at, distance): each state marker goes to the resource that is the fewest characters away.

    resources (resource, phrase), markers (phrase, status). Both are found in one pass; a sweep over a text's
    positions carries the last resource to the right and the next one to the left. The left one wins ties.
    """
    found = cut(occurrences(texts, resources.select("phrase").unionByName(markers.select("phrase"))))
    clean = lambda df: df.withColumn("phrase", F.trim(plain_text(F.col("phrase")))).distinct()
    none = F.lit(None)
    a = found.join(clean(resources), "phrase").select("key", "at", "resource", none.cast("int").alias("status"))
    b = found.join(clean(markers), "phrase").select("key", "at", none.cast("string").alias("resource"), F.col("status").cast("int").alias("status"))
    own = Window.partitionBy("key").orderBy("at", F.col("status").isNotNull(), "resource")
    here = F.when(F.col("resource").isNotNull(), F.struct("at", "resource"))
    both = a.unionByName(b).withColumns({"l": F.last(here, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "r": F.first(here, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))})
    marked = both.filter("status IS NOT NULL AND (l IS NOT NULL OR r IS NOT NULL)")
    left = F.col("r").isNull() | F.col("l").isNotNull() & (F.col("at") - F.col("l.at") <= F.col("r.at") - F.col("at"))
    best = F.when(left, F.col("l")).otherwise(F.col("r"))
    return marked.select("key", best["resource"].alias("resource"), "status", "at", F.abs(F.col("at") - best["at"]).alias("distance"))


def availability(asked: DataFrame, facts: DataFrame, roles: DataFrame, texts: DataFrame, resources: DataFrame, markers: DataFrame) -> DataFrame:
    """(key, resource, status, tier): whether a resource (key, resource) is available (1), unavailable (-1) or unknown (0).

    By its first fact that says so - `available`, `unavailable` (tier fact) or an attribute with the role (tier role) - else by
    the markers nearest to it in the question's text (tier text), of which one that says available decides.
    """
    said = F.when(exprs.local_name(F.col("p")) == "available", 1).when(exprs.local_name(F.col("p")) == "unavailable", -1)
    attribute = roles.select(F.col("id").alias("o"), F.when(exprs.role_match(F.col("role"), "resource_available"), 1).when(exprs.role_match(F.col("role"), "resource_unavailable"), -1).alias("by_role")).filter("by_role IS NOT NULL").groupBy("o").agg(F.max("by_role").alias("by_role"))
    own = facts.join(asked.select(F.col("resource").alias("s")).distinct(), "s", "left_semi").join(attribute, "o", "left")
    status = F.coalesce(said, F.when(exprs.local_name(F.col("p")) == "hasattribute", F.col("by_role")))
    told = own.withColumn("status", status).filter("status IS NOT NULL").groupBy(F.col("s").alias("resource")).agg(F.min_by(F.struct("status", F.when(said.isNotNull(), "fact").otherwise("role").alias("tier")), F.struct("seq", "o")).alias("told"))
    near = nearest_states(texts, resources, markers).groupBy("key", "resource").agg(F.max("status").alias("near"))
    got = asked.select("key", "resource").distinct().join(told, "resource", "left").join(near, ["key", "resource"], "left")
    return got.select("key", "resource", F.coalesce("told.status", "near", F.lit(0)).alias("status"), F.coalesce("told.tier", F.when(F.col("near").isNotNull(), "text"), F.lit("none")).alias("tier"))


# Predicates too weak to be asked for, and wordings that stand for a predicate (groups of words of which
# each must have one in the text; predicates tried in order).
WEAK = ["system", "systems", "be", "is", "are", "was", "were", "signal", "signals", "evidence", "between", "plausible"]
WORDINGS = [
    ([["backup"], ["system", "systems"], ["for"]], ["backupfor"]),
    ([["indicate", "indicated", "suggest", "suggested", "signal", "signals", "evidence"]], ["indicate"]),
    ([["stop", "stops", "stopped"], ["function", "functioning"]], ["stop_working", "stop"]),
    ([["function", "functioning"]], ["function", "operate"]),
    ([["restore", "restored", "regain", "regained"]], ["restore"]),
    ([["relationship", "relationships"], ["between"]], ["with"]),
    ([["explain", "explains", "explanation"]], ["cause"]),
    ([["plausible", "likely", "most", "cause", "caused"]], ["cause"]),
]


def has_words(own: Column, groups: list[list[str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.arrays_overlap(own, F.array(*map(F.lit, g))) for g in groups])


def asked_predicate(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, predicate, cue) of questions (key, text, predicate): the given predicate (cue given) unless it is missing, weak or a number.

    Then the first wording whose predicate is known (cue wording), else the first word that is, by stem or as it
    stands (cue word), is a known predicate of `vocabulary` (predicate); else null.
    """
    given = exprs.normal_token(F.coalesce("predicate", F.lit("")))
    keep = (given != "") & ~given.isin(WEAK) & ~given.rlike(r"^\d+$")
    own = df.select("key", words(F.col("text")).alias("own"), F.when(keep, F.col("predicate")).alias("given"))
    tried = [F.when(has_words(F.col("own"), groups), F.struct(F.lit(10 * i + k).alias("order"), F.lit(p).alias("predicate"), F.lit("wording").alias("cue"))) for i, (groups, ps) in enumerate(WORDINGS) for k, p in enumerate(ps)]
    entry = lambda order, p: F.struct(order.cast("int").alias("order"), p.alias("predicate"), F.lit("word").alias("cue"))
    by_word = F.flatten(F.transform("own", lambda w, i: F.array(entry(1000 + 2 * i, exprs.verb_stem(w)), entry(1001 + 2 * i, w))))
    each = own.filter("given IS NULL").select("key", F.explode(F.concat(F.array_compact(F.array(*tried)), by_word)).alias("x")).select("key", "x.*")
    first = each.join(vocabulary.select("predicate").distinct(), "predicate", "left_semi").groupBy("key").agg(F.min_by(F.struct("predicate", "cue"), "order").alias("x"))
    got = own.join(first, "key", "left")
    return got.select("key", F.coalesce("given", "x.predicate").alias("predicate"), F.when(F.col("given").isNotNull(), "given").otherwise(F.col("x.cue")).alias("cue"))


def condition_bridge(df: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, predicate, object, failed, preserved, routing) of texts (key, text) that ask for conditions; they ask without a subject.

    What stops or still functions depends on what powers it: the first known entity (symbol, surface) of the text is the
    resource. "Under what conditions" is a cause chain over the same predicate.
    """
    own = words(F.col("text"))
    anyof = lambda *names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    stops = anyof("stop", "stops", "stopped") & anyof("function", "functioning", "working") | anyof("still") & anyof("function", "functioning", "operate", "operational")
    asks = anyof("condition", "conditions") & anyof("under", "what")
    marked = df.select("key", "text", stops.alias("stops"), asks.alias("asks")).filter("stops OR asks")
    surfaces = entities.select("symbol", F.trim(plain_text(F.col("surface"))).alias("phrase"))
    there = occurrences(marked.filter("stops").select("key", "text"), surfaces.select("phrase")).join(surfaces, "phrase")
    first = there.groupBy("key").agg(F.min_by("symbol", F.struct("at", (-F.length("phrase")).alias("shorter"), "symbol")).alias("object"))
    got = marked.join(first, "key", "left").filter("object IS NOT NULL OR asks")
    resource = F.col("object").isNotNull()
    return got.select("key", F.lit("poweredby").alias("predicate"), "object", resource.alias("failed"), (~resource).alias("preserved"), F.when(resource, "RELATION_MATCH").otherwise("CAUSE_CHAIN").alias("routing"))
