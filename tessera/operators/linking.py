"""Linking of phrases to symbols: exact, token postings, scores, n-gram tagging, vectors, markers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .ontology import counted, cut


def postings(known: DataFrame) -> DataFrame:
    """(token, symbol) of the known symbols."""
    return known.select(F.explode(F.array_distinct(exprs.tokens(F.col("symbol")))).alias("token"), "symbol")


def exact(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, symbol): entity or concept of the phrase, its singular or plural; the lowest priority wins."""
    form = exprs.normal_token(F.col("phrase"))
    keys = F.array(*[F.concat(F.lit(n), f) for f in (form, exprs.singular(form), exprs.plural(form)) for n in ("entity:", "concept:")])
    tried = phrases.select("phrase", F.posexplode(keys).alias("priority", "symbol"))
    return tried.join(known, "symbol", "left_semi").groupBy("phrase").agg(F.min_by("symbol", "priority").alias("symbol"))


def by_tokens(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, symbol): of the symbols that share a token with a text and whose display form stands in it as whole words, the most specific."""
    each = texts.select("key", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9]+"))).alias("token"))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "), F.lit(" "))
    # A text that holds the whole form holds its rarest token too, so a common token pairs nothing.
    own = postings(known)
    rare = own.join(own.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("symbol").agg(F.min(F.struct("n", "token")).alias("x")).select("symbol", "x.token")
    hits = each.join(rare, "token").filter(padded.contains(F.concat(F.lit(" "), exprs.display(F.col("symbol")), F.lit(" "))))
    return hits.groupBy("key").agg(F.max_by("symbol", F.struct(F.round(exprs.specificity(F.col("symbol")), 6), "symbol")).alias("symbol"))


def parts_of(bare: Column) -> Column:
    """All substrings of a name that have a token of the name among their own tokens."""
    starts = F.sequence(F.lit(1), F.length(bare))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.length(bare)), lambda j: F.substring(bare, i, j - i + 1))))
    own = F.filter(F.split(F.lower(bare), r"[_\s]+"), lambda w: w != "")
    return F.array_distinct(F.filter(every, lambda x: F.arrays_overlap(F.split(x, "_"), own)))


def scored(phrases: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """(phrase, symbol, score): equal 2.0 or singular-equal 1.6, contains +0.8, singular contains +0.6; the best, then the last by name.

    Phrase and symbol share a token. No pairs are looked through: what is equal, or equal in the singular, meets on
    that form; what contains a phrase has the same score whatever it is, so of all names with a part the last one is kept
    before the phrases come. A symbol costs the square of its own length.
    """
    if least <= 0.6:
        raise ValueError("scores of 0.6 and less are not looked up")
    form = exprs.normal_token(F.col("phrase"))
    own = phrases.select("phrase", form.alias("form")).filter("form <> ''").distinct()
    named = known.select("symbol", exprs.strip_namespace(F.col("symbol")).alias("bare")).distinct()
    shares = F.arrays_overlap(F.split("form", "_"), exprs.tokens(F.col("symbol")))
    same = own.withColumn("one", exprs.singular(F.col("form"))).join(named.withColumn("one", exprs.singular(F.col("bare"))), "one").filter(shares)
    bare, one = F.col("bare"), exprs.singular(F.col("form"))
    score = F.when(bare == F.col("form"), 2.0).otherwise(1.6) + F.when(bare.contains(F.col("form")), 0.8).otherwise(0.0) + F.when(bare.contains(one), 0.6).otherwise(0.0)
    holding = named.select("symbol", F.explode(parts_of(bare)).alias("form")).groupBy("form").agg(F.max("symbol").alias("symbol"))
    every = same.select("phrase", "symbol", score.alias("score")).unionByName(own.join(holding, "form").select("phrase", "symbol", F.lit(1.4).alias("score")))
    best = every.withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)
    return best.groupBy("phrase").agg(F.max(F.struct("score", "symbol")).alias("x")).select("phrase", "x.symbol", "x.score")


def mentions(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, n, symbol): phrases between commas and "and", linked exactly, else by score."""
    each = texts.select("key", F.posexplode(F.split("text", r"\s*(?:,|\band\b)\s*")).alias("n", "phrase")).filter(F.trim("phrase") != "")
    phrases = each.select("phrase").distinct()
    one = exact(phrases, known).withColumnRenamed("symbol", "exact")
    two = scored(phrases, known).select("phrase", F.col("symbol").alias("close"))
    return each.join(one, "phrase", "left").join(two, "phrase", "left").select("key", "n", F.coalesce("exact", "close").alias("symbol")).filter("symbol IS NOT NULL")


def ngram_tags(texts: DataFrame, dictionary: DataFrame, longest: int = 4) -> DataFrame:
    """(key, start, length, term): dictionary terms of up to `longest` words, greedy from the left, longest first, none overlapping.

    Grams meet the dictionary in an equi-join; the choice is made over each text's own sorted hits.
    """
    own = texts.select("key", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
    grams = own.select("key", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("length")).select(
        "key", "length", F.posexplode(F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + F.col("length") - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("start", "term")
    )
    hits = grams.join(counted(dictionary.select("term").distinct(), "term"), "term")
    sorted_ = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("length")).alias("less"), "term"))).alias("all"))
    chosen = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,less:int,term:string>>").alias("kept")),
        lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((x["start"] - x["less"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
    )
    return sorted_.select("key", F.explode(chosen["kept"]).alias("x")).select("key", "x.start", (-F.col("x.less")).alias("length"), "x.term")


def hashed_vectors(labels: DataFrame) -> DataFrame:
    """(label, slot, w): L2-normalised hashed trigram vectors in sparse form."""
    each = labels.select("label", F.explode(exprs.trigram_slots(F.col("label"))).alias("x")).groupBy("label", "x.slot").agg(F.sum("x.sign").alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("label")))
    return each.filter("w <> 0").withColumn("size", size).select("label", "slot", (F.col("w") / F.col("size")).alias("w"))


def unit_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """(label, slot, w): given vectors (label, array) as L2-normalised sparse rows; zero vectors have none."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v))
    return vectors.withColumn("size", size).filter("size > 0").select("label", "size", F.posexplode(vector).alias("slot", "v")).select("label", "slot", (F.col("v").cast("double") / F.col("size")).alias("w"))


def exact_nearest_label(queries: DataFrame, vectors: DataFrame, least: float = 0.6, vectorizer: Callable[[DataFrame], DataFrame] = hashed_vectors) -> DataFrame:
    """(query, label, score): the known label with the largest cosine; sparse vectors meet on their slots, so pairs grow with the square."""
    mine = vectorizer(queries.select(F.col("query").alias("label"))).select(F.col("label").alias("query"), "slot", F.col("w").alias("v"))
    dots = mine.join(vectors, "slot").groupBy("query", "label").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("score"))
    return dots.filter(F.col("score") >= least).groupBy("query").agg(F.max(F.struct("score", "label")).alias("x")).select("query", "x.label", "x.score")


#: Tables of the index, bits of its signatures that a query also tries turned round, labels meant to share a bucket.
TABLES, PROBES, BUCKET = 6, 4, 2


def signatures(vectors: DataFrame, bits: int, tables: int = TABLES) -> DataFrame:
    """(label, tab, sums): on which side of `bits` random hyperplanes a table a vector (label, slot, w) lies, and how far from them.

    A plane's component in a slot is 1 or -1 by a bit of a hash of slot and table.
    """
    each = vectors.select("label", "slot", "w", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("tab")).withColumn("h", F.xxhash64("slot", "tab"))
    side = lambda k: F.sum(F.when(F.shiftright("h", k).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w")))
    return each.groupBy("label", "tab").agg(F.array(*[side(k) for k in range(bits)]).alias("sums"))


def bucket(sums: Column) -> Column:
    return F.aggregate(F.transform(sums, lambda x, k: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def probed(sums: Column, probes: int) -> Column:
    """A vector's bucket and those with one or two of its `probes` least certain bits turned round."""
    order = F.slice(F.array_sort(F.transform(sums, lambda x, k: F.struct(F.abs(x).alias("far"), k.cast("int").alias("k")))), 1, probes)
    bit = F.transform(order, lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["k"]))
    twice = F.flatten(F.transform(bit, lambda a: F.transform(F.filter(bit, lambda b: b > a), lambda b: a.bitwiseOR(b))))
    return F.transform(F.concat(F.array(F.lit(0).cast("long")), bit, twice), lambda x: bucket(sums).bitwiseXOR(x))


def candidate_labels(mine: DataFrame, vectors: DataFrame, tables: int = TABLES, probes: int = PROBES, in_bucket: int = BUCKET) -> DataFrame:
    """(query, label) worth comparing: vectors that share a bucket in some table.

    Signatures have as many bits as leave about `in_bucket` labels a bucket, so pairs grow with the queries and not with the labels.
    """
    labels = vectors.select("label").distinct().count()
    bits = max(2, min(40, math.ceil(math.log2(max(2, labels) / in_bucket))) if labels > in_bucket else 2)
    known = signatures(vectors, bits, tables).select("label", "tab", bucket(F.col("sums")).alias("b"))
    asked = signatures(mine, bits, tables).select(F.col("label").alias("query"), "tab", F.explode(probed(F.col("sums"), probes)).alias("b"))
    return asked.join(known, ["tab", "b"]).select("query", "label").distinct()


def nearest_label(queries: DataFrame, vectors: DataFrame, least: float = 0.6, vectorizer: Callable[[DataFrame], DataFrame] = hashed_vectors, **index) -> DataFrame:
    """(query, label, score): the known label with the largest cosine of those that a hyperplane index offers.

    `vectorizer` makes (label, slot, w) of (label), as it made the vectors. Cosines are exact; a query that the
    index has nothing for is compared with all labels. Labels with one vector are one entry, named by the last of them.
    Recall against `exact_nearest_label` is measured in the tests.
    """
    as_map = lambda df: df.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "w")))).alias("v"))
    classes = as_map(vectors).withColumn("same", F.xxhash64(F.map_entries("v"))).groupBy("same", F.map_entries("v").alias("e")).agg(F.max("label").alias("label")).select("label", F.map_from_entries("e").alias("v"))
    known = cut(classes)
    mine = cut(vectorizer(queries.select(F.col("query").alias("label")).distinct()).select("label", "slot", "w"))
    entries = known.select("label", F.explode("v").alias("slot", "w"))
    met = candidate_labels(mine, entries, **index).join(known.withColumnRenamed("v", "theirs"), "label").join(as_map(mine).select(F.col("label").alias("query"), F.col("v").alias("mine")), "query")
    dot = F.aggregate(F.map_entries("mine"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("theirs", e["key"]), F.lit(0.0)))
    scored_ = met.select("query", "label", F.round(dot, 9).alias("score")).filter(F.col("score") >= least)
    found = cut(scored_.groupBy("query").agg(F.max(F.struct("score", "label")).alias("x")).select("query", "x.label", "x.score"))
    rest = queries.select("query").distinct().join(found, "query", "left_anti")
    return found.unionByName(exact_nearest_label(rest, entries, least, vectorizer))


def centroids(vectors: DataFrame, cluster: str, vector: str, weight: str) -> DataFrame:
    """(cluster, slot, value): weighted sum of a cluster's vectors, L2-normalised."""
    each = vectors.select(cluster, F.posexplode(vector).alias("slot", "v"), weight).groupBy(cluster, "slot").agg(F.sum(F.col("v").cast("double") * F.col(weight)).alias("v"))
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(cluster)))
    return each.select(cluster, "slot", (F.col("v") / size).alias("value"))


def nearest_centroid(vectors: DataFrame, key: str, vector: str, centres: DataFrame, cluster: str) -> DataFrame:
    """(key, cluster, score): the centre with the largest cosine; centres are few and meet by slot."""
    each = vectors.select(key, F.posexplode(vector).alias("slot", "v"))
    size = F.sqrt(F.sum(F.col("v").cast("double") * F.col("v")).over(Window.partitionBy(key)))
    dots = each.withColumn("u", F.col("v").cast("double") / size).join(centres, "slot").groupBy(key, cluster).agg(F.sum(F.col("u") * F.col("value")).alias("score"))
    return dots.groupBy(key).agg(F.max_by(F.struct(F.col(cluster), "score"), "score").alias("x")).select(key, f"x.{cluster}", "x.score")


def nearest_marker(texts: DataFrame, resources: DataFrame, markers: DataFrame) -> DataFrame:
    """(key, at, marker, resource, distance): each marker word with the resource word (both tables of `term`) at the least distance."""
    each = texts.select("key", F.posexplode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("pos", "term"))
    a = each.join(markers.distinct(), "term", "left_semi").select("key", F.col("pos").alias("mp"), F.col("term").alias("marker"))
    b = each.join(resources.distinct(), "term", "left_semi").select("key", F.col("pos").alias("rp"), F.col("term").alias("resource"))
    # The nearest to the left and to the right by one pass over the merged positions of a text.
    both = a.select("key", F.col("mp").alias("pos"), F.lit(1).alias("kind"), F.col("marker").alias("w")).unionByName(b.select("key", F.col("rp").alias("pos"), F.lit(0).alias("kind"), F.col("resource").alias("w")))
    own = Window.partitionBy("key").orderBy("pos", "kind")
    here = F.when(F.col("kind") == 0, F.struct("pos", "w"))
    left = F.last(here, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(here, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    got = both.withColumns({"l": left, "r": right}).filter("kind = 1 AND (l IS NOT NULL OR r IS NOT NULL)")
    take_left = F.col("r").isNull() | F.col("l").isNotNull() & (F.col("pos") - F.col("l.pos") <= F.col("r.pos") - F.col("pos"))
    best = F.when(take_left, F.col("l")).otherwise(F.col("r"))
    return got.select("key", F.col("pos").alias("at"), F.col("w").alias("marker"), best["w"].alias("resource"), F.abs(F.col("pos") - best["pos"]).alias("distance"))
