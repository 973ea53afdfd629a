"""Line dedup by distinct-site spread (operator 7, DataFrame functions only).

A line that stands on at least `least_sites` distinct sites (`source`) is boilerplate and goes from
every document. A HyperLogLog++ sketch of the sites per line hash is built in each task and merged by
aggregation. Lines whose estimate is so near the threshold that the sketch may be wrong get an exact
distinct count; the others are decided by the sketch.

Lines are compared without blanks at their ends; lines without a word are never removed. Line hashes
are 2 x 64 bits. Which lines of a text go depends only on its text, so that is worked out per text
class. Blank lines never leave the scan, and of the others only the numbers of those that go are
shuffled to the documents.

With `copies_once` a line is spread only through different texts: a document copied on many sites would
else have every line on all of them and become empty. Each text is dealt to one of its sites then, so
several copied texts may be dealt to the same one and the spread is a lower bound.

Defined results: null text stays null (no lines); a null site is the site ''; a text of which every
line goes becomes empty; very long texts only have more lines; ids may be null or repeated, rows and
other columns stay as they are; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_SITES = 10
#: Relative standard deviation of the sketch, and how many of them above the threshold count as near it.
#: Below, half the threshold does: sites that share a register make the sketch of few sites fall short.
RSD = 0.05
NEAR = 5


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(k1, k2, pos, h1, h2, site): one row per line with a word."""
    lines = docs.select(
        *common.text_key(F.col("text")), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    line = F.trim("line")
    return lines.select("k1", "k2", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), "site")


def dealt_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, site: hash) with all copies of a text dealt to one of its sites, in no preferred order."""
    mixed = F.xxhash64("site").bitwiseXOR(F.col("k1"))
    return lines.groupBy("k1", "k2", "h1", "h2").agg(F.min(mixed).bitwiseXOR(F.col("k1")).alias("site")).select("h1", "h2", "site")


def boilerplate(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, copies_once: bool = False) -> DataFrame:
    """(h1, h2) of the lines on at least `least_sites` sites; with `copies_once` a text counts for one of its sites only."""
    lines = site_lines(docs, site)
    counted = dealt_lines if copies_once else lambda some: some.select("h1", "h2", "site")
    spread = common.cut(
        counted(lines).groupBy("h1", "h2").agg(F.approx_count_distinct("site", RSD).alias("sites")).filter(F.col("sites") >= least_sites / 2)
    )
    near = F.col("sites") <= least_sites * (1 + NEAR * RSD)
    doubtful = common.broadcast_if_small(spread.filter(near).select("h1", "h2"))
    pairs = counted(lines.join(doubtful, ["h1", "h2"], "left_semi")).distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= least_sites)
    return common.cut(spread.filter(~near).select("h1", "h2").unionByName(exact.select("h1", "h2")))


def removed_lines(docs: DataFrame, lines: DataFrame, site: str = "source") -> DataFrame:
    """(k1, k2, goes: array of the numbers of the lines that go) of the texts that lose lines."""
    found = site_lines(docs, site).join(common.broadcast_if_small(lines), ["h1", "h2"], "left_semi")
    return found.groupBy("k1", "k2").agg(F.collect_set("pos").alias("goes"))  # as many as the text has lines


def dedup_lines(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, copies_once: bool = False) -> DataFrame:
    """The same rows and columns with boilerplate lines taken out of `text`, plus n_lines and n_removed."""
    lines = boilerplate(docs, site, least_sites, copies_once)
    rows = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "k1", "k2")], *common.text_key(F.col("text")))
    flagged = rows.join(removed_lines(docs, lines, site).withColumnRenamed("goes", "__goes"), ["k1", "k2"], "left")
    # A column of its own, so that a text is split once and not once for every line.
    flagged = flagged.withColumn("__parts", F.split("text", "\n"))
    parts = F.col("__parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__goes"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return flagged.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
            "n_removed": F.coalesce(F.size("__goes"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__goes").isNull(), F.col("text")).otherwise(kept),
        }
    ).select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "k1", "k2")], "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op7_line_dedup": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT r, site, i, ls[i] AS line FROM (SELECT r, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs WHERE text IS NOT NULL)),
common AS (SELECT trim(line, ' ') AS l FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1 HAVING count(DISTINCT site) >= {LEAST_SITES}),
kept AS (
  SELECT r, count(*) FILTER (WHERE l IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE l IS NULL) AS t
  FROM lines LEFT JOIN common ON trim(line, ' ') = l GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
}
