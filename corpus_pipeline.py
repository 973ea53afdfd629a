"""Corpus pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes the documents that the one before kept and returns them with the columns of
`documents`; the last returns token digests. Null or empty texts are rejected by the first stage (no
letter, so no language); repeated rows are near-copies of each other and the one with the smallest id stays, of
equal ids the one that `simhash.keep_first` names. Very long texts go through whole, each stage by its
own bound. An empty table gives an empty result. Columns beyond those of `documents` are dropped at
each stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, langid, line_dedup, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less likely than this is rejected. Of four languages the best has 0.25 at
#: least, so this keeps every text that leans to one at all, and rejects what fits all of them alike.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that fit no language; fills in a missing lang."""
    predicted = langid.predict(docs.select(*COLUMNS), langid.train(docs))
    kept = predicted.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on many sites through different texts out of the texts; no document goes.

    Copies count once, so that a copied document reaches the near-dedup whole.
    """
    return line_dedup.dedup_lines(docs, copies_once=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    marked = decontaminate.mark(docs.select(*COLUMNS), common.read(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the kept documents."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared checkpoint folder, read by the next stage and deleted after it."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = common.new_folder(spark)
        docs = common.written(stage(spark, docs, sf_dir), folder)
        if before:
            common.deleted(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
