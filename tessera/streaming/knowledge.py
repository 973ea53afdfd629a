"""Facts and rules that arrive in any order, and indexes kept from the facts as they come.

Every rule meets every fact once, whichever comes first: both are streams that a two-sided join keeps as state by
(p, o) and a part of the subjects, as very many facts may share one (p, o); a rule is kept once a part. What is derived is written as a batch's files, and these are a source of the same join, so derived
facts meet rules too, and none is read twice. No row is looked at again when others arrive later.

Every batch commits all stores of the state, whatever it brings. So a call is one query, which opens them once, commits write
what changed only, a partition of the join is one store and not four, and there are as many partitions as cores, or LEAST.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import by_predicate
from . import ingest
from .session import rocks

DERIVED = "s string, p string, o string, conf double"
TOLD = "s string, p string, o string, conf double, seq long"
#: parts that the facts of one (p, o) are dealt over
PARTS = 32
#: partitions of the state, where there are fewer cores
LEAST = 8
#: commits write changes and not files of RocksDB; a join has one store a partition
STORES = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.join.stateFormatVersion": "3"}


@contextmanager
def few_stores(spark: SparkSession):
    """Settings of a stream that is begun here; the session's own come back afterwards. A stream that goes on keeps its partitions."""
    partitions = "spark.sql.shuffle.partitions"
    own = {partitions: str(min(int(spark.conf.get(partitions)), max(LEAST, spark.sparkContext.defaultParallelism))), **STORES}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Knowledge:
    """Facts, rules and what follows from them, in a folder; `take` may be called again with the same streams.

    A rule (p, o, p2, o2, weight) says that who has p o has p2 o2. There is no bound on rounds: derived facts are made
    of the facts' subjects and the rules' consequents, so there are finitely many, and each pair of fact and rule
    meets once. That makes the result the same for every order of arrival.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or ingest.shared_folder(spark, "knowledge")
        #: rows that the sources gave to the join so far
        self.rows_read = 0
        # The derived facts' own folder must be there before it can be a source.
        spark.createDataFrame([], DERIVED).write.mode("ignore").parquet(f"{self.folder}/rows/begin/told=false")

    def take(self, facts: DataFrame, rules: DataFrame) -> DataFrame:
        """Takes what the streams have, and what follows, until nothing new does; (s, p, o, conf, seq) of all facts so far."""
        derived = self.spark.readStream.schema(DERIVED).option("recursiveFileLookup", "true").parquet(f"{self.folder}/rows/*/told=false")
        known = facts.select("s", "p", "o").unionByName(derived.select("s", "p", "o")).dropDuplicates(["s", "p", "o"])
        known = known.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(PARTS)).cast("int"))
        recorded = rules.select("p", "o", "p2", "o2", F.col("weight").cast("double").alias("weight")).dropDuplicates()
        recorded = recorded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        made = known.join(recorded, ["p", "o", "part"]).select("s", F.col("p2").alias("p"), F.col("o2").alias("o"), F.col("weight").alias("conf"), F.lit(None).cast("long").alias("seq"), F.lit(False).alias("told"))
        told = facts.select("s", "p", "o", F.col("conf").cast("double").alias("conf"), F.col("seq").cast("long").alias("seq"), F.lit(True).alias("told"))

        def each(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").partitionBy("told").parquet(f"{self.folder}/rows/batch={number}")

        # What a batch derives is there for the next one.
        with rocks(self.spark), few_stores(self.spark):
            self.rows_read += ingest.run_available(made.unionByName(told), self.folder, each, "append", True)
        return self.facts()

    def facts(self) -> DataFrame:
        """Each fact once: told ones with their first confidence by seq, derived ones with their largest weight."""
        reader = self.spark.read.option("recursiveFileLookup", "true")
        of = lambda flag: [x for batch in ingest.children(self.spark, f"{self.folder}/rows") for x in ingest.children(self.spark, batch) if x.endswith(f"/told={flag}")]
        derived = reader.schema(DERIVED).parquet(*of("false")).withColumn("seq", F.lit(None).cast("long"))
        paths = of("true")
        every = reader.schema(TOLD).parquet(*paths).unionByName(derived) if paths else derived
        order = F.struct(F.col("seq").isNull(), "seq", -F.col("conf"))
        return every.groupBy("s", "p", "o").agg(F.min_by(F.struct("conf", "seq"), order).alias("x")).select("s", "p", "o", "x.*")


#: Predicates by local name. Fixed values.
DEPENDENCY = ("poweredby", "require", "requires")
TEMPORAL = ("before", "after", "during")


def local_name(predicate: Column) -> Column:
    return F.lower(F.regexp_extract(predicate, "([^#/:]*)$", 1))


class Indexes:
    """Four indexes over a stream of facts, kept as one aggregation by (index, key, member).

    * postings: local predicate -> the facts that have it;
    * dependents: resource -> the subjects that are powered by it or require it;
    * temporal: symbols that stand before, after or during something;
    * signal: subjects of the role `evidence_signal` -> the largest weight of their predicates.

    A batch's facts are turned into rows of all indexes at once and pre-aggregated; the state merges them by
    maximum and count, so only touched entries are written. `entries` is the newest state.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or ingest.shared_folder(spark, "indexes")
        self.versions = ingest.Versions(spark, self.folder, spark.createDataFrame([], "index string, key string, member string, value double, n long").schema, ["index", "key", "member"])

    @staticmethod
    def rows(facts: DataFrame, weights: DataFrame, signals: DataFrame) -> DataFrame:
        """(index, key, member, value) of facts (s, p, o); weights is (p, weight), signals (id) with the role."""
        local = local_name(F.col("p"))
        entry = lambda index, key, member, value: F.struct(F.lit(index).alias("index"), key.alias("key"), member.alias("member"), value.alias("value"))
        one, none = F.lit(1.0), F.lit("")
        named = by_predicate(facts.withColumn("local", local), weights.select("p", "weight"), "left").join(signals.select(F.col("id").alias("s"), F.lit(True).alias("signals")).distinct(), "s", "left")
        entries = F.array(
            entry("postings", F.col("local"), F.concat_ws(" ", "s", "p", "o"), one),
            F.when(F.col("local").isin(*DEPENDENCY), entry("dependents", F.col("o"), F.col("s"), one)),
            F.when(F.col("local").isin(*TEMPORAL), entry("temporal", F.col("s"), none, one)),
            F.when(F.col("local").isin(*TEMPORAL), entry("temporal", F.col("o"), none, one)),
            F.when(F.col("signals") & (F.col("weight") > 0), entry("signal", F.col("s"), none, F.col("weight").cast("double"))),
        )
        return named.select(F.explode(F.array_compact(entries)).alias("x")).select("x.*").filter("key IS NOT NULL")

    def take(self, facts: DataFrame, weights: DataFrame, signals: DataFrame) -> DataFrame:
        state = self.rows(facts, weights, signals).groupBy("index", "key", "member").agg(F.max("value").alias("value"), F.count("*").alias("n"))
        with rocks(self.spark):
            ingest.run_available(state, self.folder, self.versions.write, mode="update")
        return self.entries()

    def entries(self) -> DataFrame:
        return self.versions.newest().drop("number")


class LabelIndex:
    """token -> entities, from a stream of entities (id, label, seq) of which the newest label counts.

    A label that comes later replaces all tokens of the one before, so the state is an entity's newest label.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or ingest.shared_folder(spark, "labels")

    def take(self, entities: DataFrame) -> DataFrame:
        with rocks(self.spark):
            labels = ingest.newest(entities, ["id"], F.max_by("label", F.struct("seq", "label")).alias("label"), folder=self.folder)
        return labels.select(F.explode(F.array_distinct(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"))).alias("token"), "id").filter("token <> ''")
