"""Host-level quality rules (operator 9, DataFrame functions only).

Per document, in one pass over its text and without leaving the row: words, characters in words,
symbols, repeated lines, words in repeated three-word windows, and the rules on them. Rule failures
are aggregated by host (`source`), each host's failure rate is shrunk towards a beta prior fitted to
all hosts by moments, and a host whose shrunk rate is above the limit loses all its documents.

Windows are grouped by sorting a text's own windows, so no window leaves its row and no long text
needs more than its own memory.

Defined results: null text has no words and fails; a null host is the host ''; ids may be null or
repeated, each row gives one row; a host at the limit itself stays; an empty table gives none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5
MOST_SYMBOLS = 0.1
MOST_DUP_LINES = 0.5
#: A host fails when its shrunk failure rate is above this.
HOST_LIMIT = 0.6


def measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; drop `text`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    own = docs.withColumns(
        {
            "words": common.white_words(F.col("text")),
            "n_symbols": (F.length(text) - F.length(bare)).cast("long"),
            "lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    ).drop("text")
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda word, i: F.struct(F.concat_ws(" ", word, F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("at")),
    )
    own = own.withColumn("sorted", F.sort_array(windows))
    same = lambda x, i: F.coalesce(x["w"] == F.get("sorted", i)["w"], F.lit(False))
    repeated = F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.flatten(F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return own.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(places)).cast("long"),
        }
    ).drop("words", "lines", "sorted")


def rules(measured: DataFrame) -> DataFrame:
    """Add base_failed and failed (any rule)."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    more = (F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
    return measured.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(ruled: DataFrame, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, n_failed, rate: shrunk, host_failed)."""
    hosts = ruled.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_samp(raw).alias("v"))
    # Beta moments: a + b = m (1 - m) / v - 1; without spread between hosts every host has the mean.
    strength = F.when(F.coalesce(F.col("v"), F.lit(0.0)) <= 0, 1e9).otherwise(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0)))
    prior = prior.select("m", strength.alias("strength"))  # one row
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(host, "n", "n_failed", shrunk.alias("rate"), (shrunk > limit).alias("host_failed"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Every row of (doc_id, text, source) with its measures, base_failed, rate and kept."""
    own = docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit("")).alias("host"))
    ruled = common.cut(rules(measures(own)))
    verdicts = common.cut(host_verdicts(ruled, limit=limit))
    joined = ruled.join(common.broadcast_if_small(verdicts.select("host", "rate", "host_failed")), "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = {
    "op9_quality": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r),
own AS (
  SELECT r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeated USING (r)),
ruled AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM own),
failing AS (SELECT *, base_failed OR n_symbols > {MOST_SYMBOLS} * word_chars OR n_dup_lines > {MOST_DUP_LINES} * n_lines AS failed FROM ruled),
hosts AS (SELECT host, count(*) AS n, sum(CAST(failed AS INT)) AS f FROM failing GROUP BY host),
prior AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
verdicts AS (
  SELECT host, (f + m * k) / (n + k) > {HOST_LIMIT} AS host_failed
  FROM hosts, (SELECT m, CASE WHEN coalesce(v, 0) <= 0 THEN 1e9 ELSE greatest(m * (1 - m) / v - 1, 0) END AS k FROM prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM ruled JOIN verdicts USING (host)""",
}
