"""Incremental ingestion with Structured Streaming: facts, rules, indexes, session memory, answers.

What is known is state of the stream, kept by key, so a batch costs what it brings and not what was
written before. Every batch writes its own folder (batch=N, overwritten when a batch is run again), so
a restarted query neither loses nor repeats rows. State and outputs live in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

def shared_folder(spark: SparkSession, name: str) -> str:
    from ..operators.ontology import cut

    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1).toDF("x"))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files.

    A single file may only be named by a pattern, so the last letter is given as one.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append", follow: bool = False) -> int:
    """Runs what is there in batches, with offsets in `folder`, and ends; how many rows the sources gave.

    With `follow` it also takes what its own batches add to the sources, by the same query, until there is nothing new.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/offsets")
    if follow:
        query = writer.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def read_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")


#: So many batches are folded into one table of what is newest.
FOLDED_BATCHES = 16


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def children(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in system.listStatus(folder)] if system.exists(folder) else []


class Versions:
    """Rows written batch by batch, of which those of a key's newest batch count.

    After every FOLDED_BATCHES batches what is newest becomes one table and the older ones are deleted, so
    neither files nor reading grow with the number of batches. Folding again after a failure gives the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.schema = StructType(schema.fields).add("number", "long")

    def write(self, batch: DataFrame, number: int) -> None:
        write_batch(self.folder)(batch.withColumn("number", F.lit(number).cast("long")), number)
        if number % FOLDED_BATCHES == FOLDED_BATCHES - 1:
            before = children(self.spark, f"{self.folder}/rows") + children(self.spark, f"{self.folder}/folded")
            self.newest().write.parquet(f"{self.folder}/folded/{uuid.uuid4().hex}")
            for path in before:
                delete(self.spark, path)

    def newest(self) -> DataFrame:
        """The rows of each key's newest batch, with its `number`."""
        paths = children(self.spark, f"{self.folder}/rows") + children(self.spark, f"{self.folder}/folded")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        last = F.max("number").over(Window.partitionBy(*self.keys))
        return every.withColumn("last", last).filter("number = last").drop("last")


def newest(stream: DataFrame, keys: list[str], *states, folder: str | None = None) -> DataFrame:
    """The last state of each key of a streaming aggregation, of which a batch writes the keys it touched.

    With a `folder` of an earlier call the aggregation goes on where that call ended.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "state")
    state = stream.groupBy(*keys).agg(*states)
    versions = Versions(spark, folder, state.schema, keys)
    run_available(state, folder, versions.write, mode="update")
    return versions.newest().drop("number")


def ingest_facts(facts: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The table that a stream of facts (s, p, o, conf, seq) builds: each fact once, the first confidence.

    A fact is new in the batch in which its key enters the state: then its first and its last batch time
    are the same. `keep` derives more facts from a batch's new ones (for example rules); of a fact that is
    both told and derived the told one stays, of two derived ones the earlier.
    """
    spark, folder, schema = facts.sparkSession, shared_folder(facts.sparkSession, "facts"), facts.schema
    first = F.min_by(F.struct("conf", "seq"), F.struct("seq", -F.col("conf"))).alias("x")
    state = facts.withColumn("at", F.current_timestamp()).groupBy("s", "p", "o").agg(first, F.min("at").alias("came"), F.max("at").alias("at"))

    def each(batch: DataFrame, number: int) -> None:
        new = batch.filter("came = at").select("s", "p", "o", "x.*").select(*schema.names).withColumn("told", F.lit(True))
        if keep is not None:
            new = new.persist()
            derived = keep(new.drop("told")).select(*schema.names).withColumn("told", F.lit(False))
            write_batch(folder)(new.unionByName(derived), number)
            new.unpersist()
        else:
            write_batch(folder)(new, number)

    run_available(state, folder, each, mode="update")
    every = read_batches(spark, folder, StructType(schema.fields).add("told", "boolean"))
    if keep is None:
        return every.drop("told")
    order = F.struct(F.when(F.col("told"), 0).otherwise(1), "seq", -F.col("conf"))
    return every.groupBy("s", "p", "o").agg(F.min_by(F.struct("conf", "seq"), order).alias("x")).select("s", "p", "o", "x.*")


def ingest_rules(rules: DataFrame, key: list[str]) -> DataFrame:
    """Rules of a stream, each recorded once by `key`, which all columns follow from."""
    folder = shared_folder(rules.sparkSession, "rules")
    run_available(rules.dropDuplicates(key), folder, write_batch(folder))
    return read_batches(rules.sparkSession, folder, rules.schema)


def index_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key kept by a streaming aggregation; the state after the last batch."""
    return newest(stream, keys, F.count("*").alias("n"))


def session_memory(turns: DataFrame, keep: int = 50) -> DataFrame:
    """(conv_id, remembered, last_turn): per session how many of the last `keep` distinct texts are held.

    The state is the last turn of each text of a session, so a long session is many keys. A null text is
    no memory, but its turn counts.
    """
    texts = newest(turns, ["conv_id", "text"], F.max("turn").cast("long").alias("turn"))
    last = texts.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    held = texts.filter("text IS NOT NULL").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    counted = held.groupBy("conv_id").agg(F.count("*").alias("remembered"))
    return last.join(counted, "conv_id", "left").select("conv_id", F.coalesce("remembered", F.lit(0)).alias("remembered"), "last_turn")


def answer_stream(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal_id, answer): a stream of goals (goal_id, subject, predicate) joined with the fact table."""
    spark, folder = goals.sparkSession, shared_folder(goals.sparkSession, "answers")
    joined = goals.join(facts.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("answer")), ["subject", "predicate"]).select("goal_id", "answer")
    run_available(joined, folder, write_batch(folder))
    return read_batches(spark, folder, joined.schema)
