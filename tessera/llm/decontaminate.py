"""Benchmark decontamination by a distributed positional inverted index (operator 5, DataFrame functions only).

A test window is 10 consecutive words of a benchmark item (a shorter item is one window). Words are
taken between ASCII non-alphanumerics after A-Z were lower-cased.

1. Corpus frequency of every word that occurs in a window, over all documents.
2. Each window is looked up by its two rarest words. Their postings - text class and position - are the
   stored index; all other words never leave the scan.
3. The two posting lists of a window, each shifted by the word's offset in the window, are intersected on
   (text class, start). Where both have the same start, the phrase may stand: the window's words are
   compared there, in the few texts that have such places. Where the starts differ by `slop` words at
   most, it is a proximity match.
4. Per text, the covered words are counted from sorted intervals with a running maximum.

Benchmark tables are broadcast only after they were counted and found small; otherwise the lookups
become shuffle joins. Rows that have the same text share one text class (see `common`).

Defined results: a null text has no words; items without words give no window; a null item_id is
written as an empty string; repeated items count once per item_id; ids may be null or repeated, each
document row gives one row; very long texts only have more postings; of equally rare words the lesser
is looked up first; empty tables give zero counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 10
LOOKUP_WORDS = 2
#: Words by which the distance of a proximity match may differ from that in the window.
SLOP = 2


def test_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(w: window id, words, items: the sorted item_ids that have it)."""
    words = F.transform(common.contract_words(F.col("text")), common.lower_ascii)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    each = items.filter(F.size("all") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("w", F.xxhash64(F.concat_ws(" ", "words")))


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): occurrences of the vocabulary's words in all documents."""
    found = docs.select(F.explode(common.contract_words(F.col("text"))).alias("word")).select(common.lower_ascii(F.col("word")).alias("term"))
    return found.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def lookups(docs: DataFrame, windows: DataFrame, terms: int = LOOKUP_WORDS) -> DataFrame:
    """(term, w, offset, rank, terms): the rarest words of each window, rank 0 the rarest; terms is their number.

    A word's offset is that of its first place in the window.
    """
    places = windows.select("w", "words", F.posexplode(F.array_distinct("words")).alias("_", "term")).select("w", "term", (F.expr("array_position(words, term)") - 1).cast("int").alias("offset"))
    vocabulary = common.broadcast_if_small(common.cut(places.select("term").distinct()))
    counted = places.join(common.broadcast_if_small(common.cut(frequencies(docs, vocabulary))), "term", "left")
    order = Window.partitionBy("w").orderBy(F.coalesce("n", F.lit(0)), "term")
    ranked = counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < terms)
    return common.cut(ranked.withColumn("terms", F.count("*").over(Window.partitionBy("w"))).select("term", "w", "offset", "rank", "terms"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (k1, k2, n_words, term, pos) of the looked-up words.

    One more row per text, that of its last word, carries the text's length even where `term` is null.
    """
    known = common.broadcast_if_small(terms).withColumn("is_term", F.lit(True))
    own = docs.select(*common.text_key(F.col("text")), common.contract_words(F.col("text")).alias("words"))
    words = own.select("k1", "k2", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word")).withColumn("term", common.lower_ascii(F.col("word")))
    found = words.join(known, "term", "left").filter(F.col("is_term") | (F.col("pos") == F.col("n_words") - 1))
    return found.select("k1", "k2", "n_words", F.when(F.col("is_term"), F.col("term")).alias("term"), "pos")


def intersected(postings: DataFrame, lookup: DataFrame, slop: int = SLOP) -> DataFrame:
    """(k1, k2, w, start, phrase, near): starts that both lists of a window have (phrase), or have within `slop` words (near; by the second word).

    The shorter list is given with every shift that counts as near, so that both meet by equality. Pairs
    in one text are combined before the shuffle.
    """
    start = F.col("pos") - F.col("offset")
    shifts = F.when((F.col("rank") == 0) & (F.col("terms") > 1), F.sequence(F.lit(-slop), F.lit(slop))).otherwise(F.array(F.lit(0)))
    lists = postings.filter(F.col("term").isNotNull()).join(common.broadcast_if_small(lookup), "term").select("k1", "k2", "w", "rank", "terms", start.alias("at"), F.explode(shifts).alias("shift"))
    first, second = F.col("rank") == 0, (F.col("rank") == 1) | (F.col("terms") == 1)
    met = lists.groupBy("k1", "k2", "w", (F.col("at") + F.col("shift")).alias("start")).agg(F.max(first).alias("near"), F.max(first & (F.col("shift") == 0)).alias("same"), F.max(second).alias("second"))
    return met.filter("near AND second").select("k1", "k2", "w", "start", F.col("same").alias("phrase"), F.lit(True).alias("near"))


def phrase_matches(docs: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(k1, k2, start, words): the candidates (k1, k2, w, start) at which the window's words stand consecutively."""
    places = common.cut(candidates.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "w")).alias("places")))  # as many as the text has
    few = common.broadcast_if_small(places, size=16 * F.size("places"))
    own = docs.select(*common.text_key(F.col("text")), "text").join(few, ["k1", "k2"])
    each = own.select("k1", "k2", F.transform(common.contract_words(F.col("text")), common.lower_ascii).alias("all"), F.explode("places").alias("place")).select("k1", "k2", "all", "place.*")
    asked = each.join(common.broadcast_if_small(windows.select("w", "words"), size=F.length(F.concat_ws(" ", "words"))), "w")
    there = (F.col("start") >= 0) & (F.slice("all", F.greatest("start", F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return asked.filter(there).select("k1", "k2", "start", "words").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per text class: k1, k2, n_words, n_hit, n_near, items (sorted array)."""
    with common.shuffle_files_dropped(docs.sparkSession):
        windows = common.cut(test_windows(benchmark))
        lookup = lookups(docs, windows)
        postings = common.cut(index(docs, lookup.select("term").distinct()))
        met = common.cut(intersected(postings, lookup))
        hits = common.cut(phrase_matches(docs, met.filter("phrase"), windows))
    by_text = Window.partitionBy("k1", "k2").orderBy("start")
    spans = hits.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.size("words")).alias("end"))
    reached = F.coalesce(F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    items = (
        hits.select("k1", "k2", "words").distinct()
        .join(common.broadcast_if_small(windows.select("words", "items"), size=F.length(F.concat_ws(" ", "words", "items"))), "words")
        .groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    lengths = postings.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    near = met.groupBy("k1", "k2").agg(F.count("*").alias("n_near"))
    return lengths.join(covered, ["k1", "k2"], "left").join(items, ["k1", "k2"], "left").join(near, ["k1", "k2"], "left")


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document row with n_words, n_hit, n_near (places of proximity matches, phrases included), items, contaminated; other columns stay."""
    new = ["n_words", "n_hit", "n_near", "items", "contaminated"]
    rows = docs.select(*[c for c in docs.columns if c not in (*new, "k1", "k2")], *common.text_key(F.col("text")))
    found = rows.join(contamination(docs, benchmark), ["k1", "k2"], "left").drop("k1", "k2")
    return found.withColumns(
        {
            "n_words": F.coalesce(F.col("n_words").cast("long"), F.lit(0)),
            "n_hit": F.coalesce(F.col("n_hit").cast("long"), F.lit(0)),
            "n_near": F.coalesce(F.col("n_near").cast("long"), F.lit(0)),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "contaminated": F.coalesce(F.col("n_hit"), F.lit(0)) > 0,
        }
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    marked = mark(docs.select(F.col("doc_id").cast("long"), "text"), benchmark.select("item_id", "text"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near"
    )


def contract_words_sql(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL = {
    "op5_decontaminate": f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {contract_words_sql('text')} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {contract_words_sql('text')} AS ws FROM documents),
grams AS (
  SELECT r, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
hits AS (SELECT r, i, g.size, item FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r),
posts AS (SELECT r, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
terms AS (
  SELECT gram, word, list_position(string_split(gram, ' '), word) AS place, row_number() OVER (PARTITION BY gram ORDER BY coalesce(n, 0), word) AS rank
  FROM (SELECT DISTINCT gram, unnest(string_split(gram, ' ')) AS word FROM windows) LEFT JOIN (SELECT word, count(*) AS n FROM posts GROUP BY 1) USING (word) QUALIFY rank <= 2),
lists AS (SELECT r, gram, rank, i - place AS start FROM posts JOIN terms USING (word)),
near AS (
  SELECT r, count(DISTINCT (gram, start)) AS n_near FROM (
    SELECT b.r, b.gram, b.start FROM lists a JOIN lists b ON a.r = b.r AND a.gram = b.gram AND a.rank = 1 AND b.rank = 2 AND abs(a.start - b.start) <= {SLOP}
    UNION ALL SELECT r, gram, start FROM lists WHERE gram IN (SELECT gram FROM terms GROUP BY 1 HAVING count(*) = 1)) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r) LEFT JOIN near USING (r)""",
}
