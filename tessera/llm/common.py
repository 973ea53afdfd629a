"""Shared helpers of the training-data operators.

Rows are identified by their text, never by ``doc_id``: ids may be null or repeated. Two 64-bit
hashes of the text (`text_key`) name a *text class*; every result that depends only on the text is
worked out once per class and joined back to the rows, so thousands of exact copies cost one.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts that take words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z
#: were lower-cased; upper-case letters belong to words here because lower-casing comes later.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables up to this many rows (of bounded width) are hinted for broadcast after they were counted.
BROADCAST_ROWS = 100_000
#: Bytes of variable width that such tables may hold.
BROADCAST_BYTES = 16 << 20
#: Bytes and rows of an Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which a cluster shares too.

    Only where driver and executors are one process (``local[n]``, as in tests) is it a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        one = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="spark-") if one else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a (small) intermediate table to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Hint a broadcast only if the table was counted and is small; else Spark plans a shuffle join.

    ``df`` should be cheap to count (a checkpoint or a small aggregate). `size` is the bytes of a row's
    columns of variable width, whose sum is bounded too.
    """
    few = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.lit(0) if size is None else size).alias("bytes")).first()
    return F.broadcast(df) if few["n"] <= rows and (few["bytes"] or 0) <= BROADCAST_BYTES else df


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text as columns k1, k2 (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")]


def lower_ascii(word: Column) -> Column:
    """Lower-case A-Z and nothing else; words without capitals take the short way."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, UPPER.lower()))


def contract_words(text: Column) -> Column:
    """Words between ASCII non-alphanumerics, case kept; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def white_words(text: Column) -> Column:
    """Words between ASCII white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def by_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` in batches of few bytes, so that very long texts don't fill a worker's memory.

    Arrow keeps 64-bit ids and nulls as they are (pandas would turn nullable ids to doubles). The bound
    is the session's, which keeps it: Spark reads it when the job runs.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not (now := conf.get(key)).isdigit() or int(now) not in range(1, most + 1):
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within, Spark deletes an execution's shuffle files as soon as it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def scratch(spark: SparkSession):
    """Gives a `written` whose tables are deleted at the end; what is still needed then must be written by itself."""
    paths = []

    def write(df: DataFrame) -> DataFrame:
        paths.append(new_folder(spark))
        return written(df, paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            deleted(spark, path)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write an intermediate table as Parquet to the shared checkpoint folder and read it from there."""
    path = path or new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
