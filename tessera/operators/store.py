"""Fact, entity and rule tables: look-up, upsert, insertion of what is new, packs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["s", "p", "o"]


def find(facts: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Facts by subject, predicate or object; equality reaches the Parquet scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            facts = facts.filter(F.col(name) == value)
    return facts


def by_predicate(facts: DataFrame, weights: DataFrame, how: str = "inner", key: str = "p") -> DataFrame:
    """Facts with what `weights` says of their predicates, of which there are few: shuffled by them, all facts would meet in a few tasks."""
    return facts.join(F.broadcast(weights), key, how)


def upsert_entities(rows: DataFrame) -> DataFrame:
    """(id, surface, type, seq) to one row per entity: first surface form, union of types."""
    return rows.groupBy("id").agg(F.min_by("surface", "seq").alias("surface"), F.array_sort(F.collect_set("type")).alias("types"))


def typed_by_facts(facts: DataFrame) -> DataFrame:
    """(id, type) from `rdf:type` facts."""
    return facts.filter("p = 'rdf:type'").select(F.col("s").alias("id"), F.col("o").alias("type"))


def insert_if_new(known: DataFrame, new: DataFrame) -> DataFrame:
    """The new facts that are not known, each once; the first confidence by seq is kept."""
    first = new.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", F.desc("conf")))).filter("n = 1").drop("n")
    return first.join(known.select(*KEY), KEY, "left_anti")


def derived(closure: DataFrame, asserted: DataFrame) -> DataFrame:
    """Facts of the closure that were not asserted."""
    return closure.select(*KEY).distinct().join(asserted.select(*KEY), KEY, "left_anti")


def merge_packs(annotations: DataFrame) -> DataFrame:
    """(iri, annotation, value, pack_no): of each annotation the first pack that has a value wins."""
    order = Window.partitionBy("iri", "annotation").orderBy("pack_no", "value")
    return annotations.filter("value IS NOT NULL").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def sections(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to (file, line_no, section, text): the last `#` header above a line is its section.

    Blank lines go; leading enumeration is stripped.
    """
    from ..functions.exprs import strip_enumeration

    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", "")))
    marked = lines.withColumn("section", F.last(header, ignorenulls=True).over(above))
    return marked.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "line_no", "section", strip_enumeration(F.trim("line")).alias("text"))


def cases(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) with `## Qn` blocks to (file, n, question, expected: the lines that follow)."""
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.when(F.col("line").rlike(r"^##\s*Q\d+"), F.regexp_extract("line", r"Q(\d+)", 1).cast("long"))
    marked = lines.withColumn("n", F.last(n, ignorenulls=True).over(above)).filter(F.col("n").isNotNull() & ~F.col("line").startswith("#") & (F.trim("line") != ""))
    each = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    got = marked.groupBy("file", "n").agg(F.transform(each, lambda x: x["line"]).alias("all"))
    return got.select("file", "n", F.get("all", F.lit(0)).alias("question"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("expected"))


def evaluated(cases: DataFrame) -> DataFrame:
    """Cases (expected: array, answer) with `ok`: each keyword of every expected line occurs in the answer. A null answer is wrong."""
    words = F.split(F.lower(F.array_join("expected", " ")), r"[^\p{L}\p{N}_]+")
    keywords = F.filter(words, lambda w: (w != "") & ~w.isin("the", "of", "a", "is", "in"))
    return cases.withColumn("ok", F.coalesce(F.forall(keywords, lambda w: F.lower("answer").contains(w)), F.lit(False)))


def recent(rows: DataFrame, session: str, value: str, seq: str, keep: int) -> DataFrame:
    """The last `keep` distinct values of each session, newest first (`place` from 1)."""
    last = rows.groupBy(session, value).agg(F.max(seq).alias("last"))
    order = Window.partitionBy(session).orderBy(F.desc("last"), value)
    return last.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= keep)


def trace(candidates: DataFrame, depth: int) -> DataFrame:
    """Ranked candidates of each goal down to `depth`, the winner marked; needs a `rank` column."""
    return candidates.filter(F.col("rank") <= depth).withColumn("is_winner", F.col("rank") == 1)
