"""Graph view of the driver's tables: facts (s, p, o, conf, seq), entities, labels, texts.

`seq` is the order of insertion; it follows from keys, never from row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT = ["s", "p", "o", "conf", "seq"]


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def symbol(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"entity:{kind}_"), key.cast("string"))


def named(name: Column) -> Column:
    return F.concat(F.lit("entity:"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def concept(name: Column) -> Column:
    return F.concat(F.lit("concept:"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def fact(df: DataFrame, s: Column, p: str, o: Column, conf: Column, seq: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), conf.cast("double").alias("conf"), seq.cast("long").alias("seq"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def customer_places(t: Tables) -> DataFrame:
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return fact(own, symbol("customer", F.col("c_custkey")), "locatedIn", named(F.col("n_name")), F.lit(0.9), F.col("c_custkey"))


def supplier_places(t: Tables) -> DataFrame:
    own = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return fact(own, symbol("supplier", F.col("s_suppkey")), "locatedIn", named(F.col("n_name")), F.lit(0.8), F.col("s_suppkey"))


def nation_places(t: Tables) -> DataFrame:
    own = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return fact(own, named(F.col("n_name")), "in", named(F.col("r_name")), F.lit(1.0), F.col("n_nationkey"))


def places(t: Tables) -> DataFrame:
    return union(customer_places(t), supplier_places(t), nation_places(t))


def pairs(t: Tables) -> DataFrame:
    """(part, supplier) pairs that were sold."""
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


def part_with_supplier(t: Tables) -> DataFrame:
    conf = 0.5 + (F.col("l_suppkey") % 5) / 10
    return fact(pairs(t), symbol("part", F.col("l_partkey")), "with", symbol("supplier", F.col("l_suppkey")), conf, F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"))


def part_powered_by(t: Tables) -> DataFrame:
    return part_with_supplier(t).withColumn("p", F.lit("poweredBy"))


def order_requires(t: Tables) -> DataFrame:
    own = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return fact(own, symbol("order", F.col("l_orderkey")), "requires", symbol("part", F.col("l_partkey")), F.lit(0.9), F.col("l_orderkey") * 1_000_000 + F.col("l_partkey"))


def attributes(t: Tables) -> DataFrame:
    brand = fact(t.part, symbol("part", F.col("p_partkey")), "hasAttribute", concept(F.col("p_brand")), F.lit(0.9), F.col("p_partkey"))
    segment = fact(t.customer, symbol("customer", F.col("c_custkey")), "hasAttribute", concept(F.col("c_mktsegment")), F.lit(0.8), F.col("c_custkey"))
    return union(brand, segment)


def entity_types(t: Tables) -> DataFrame:
    """(id, type)."""
    return union(
        t.part.select(symbol("part", F.col("p_partkey")).alias("id"), concept(F.col("p_type")).alias("type")),
        t.supplier.select(symbol("supplier", F.col("s_suppkey")).alias("id"), F.lit("concept:supplier").alias("type")),
        t.customer.select(symbol("customer", F.col("c_custkey")).alias("id"), F.lit("concept:person").alias("type")),
        t.nation.select(named(F.col("n_name")).alias("id"), F.lit("concept:nation").alias("type")),
        t.region.select(named(F.col("r_name")).alias("id"), F.lit("concept:region").alias("type")),
    )


def subclass(t: Tables) -> DataFrame:
    """(child, parent): types of parts are products, products and people are things."""
    upper = [("product", "thing"), ("person", "thing"), ("nation", "place"), ("region", "place"), ("place", "thing")]
    pairs_ = F.array(*[F.struct(F.lit(f"concept:{a}").alias("child"), F.lit(f"concept:{b}").alias("parent")) for a, b in upper])
    # Written as an expression of `child`: Spark 4.1 can't checkpoint a union in which a branch has a literal column.
    above = t.region.limit(1).select(F.explode(pairs_).alias("x")).select("x.*")
    return t.part.select(concept(F.col("p_type")).alias("child")).distinct().withColumn("parent", F.regexp_replace("child", "^.*$", "concept:product")).unionByName(above)


def event_symbol(key: Column) -> Column:
    return symbol("event", key)


def event_order(t: Tables) -> DataFrame:
    """An event is before the next event of its user."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    each = t.events.withColumn("next", F.lead("event_id").over(own)).filter(F.col("next").isNotNull())
    return fact(each, event_symbol(F.col("event_id")), "before", event_symbol(F.col("next")), F.lit(0.9), F.col("event_id"))


def event_failures(t: Tables) -> DataFrame:
    each = t.events.filter("event_type = 'error'")
    return fact(each, event_symbol(F.col("event_id")), "fail", F.lit("concept:true"), F.lit(0.9), F.col("event_id"))


def event_causes(t: Tables) -> DataFrame:
    """An error causes its user's next event."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    each = t.events.withColumn("next", F.lead("event_id").over(own)).filter("event_type = 'error' AND next IS NOT NULL")
    return fact(each, event_symbol(F.col("event_id")), "cause", event_symbol(F.col("next")), F.lit(0.7), F.col("event_id"))


def event_types(t: Tables) -> DataFrame:
    """(id, role, user): what an event stands for."""
    role = (
        F.when(F.col("event_type") == "error", "failure")
        .when(F.col("event_type") == "click", "evidence_signal")
        .when(F.col("event_type") == "purchase", "outcome")
        .when(F.col("event_type") == "signup", "recovery_phase")
        .otherwise("temporal_marker")
    )
    return t.events.select(event_symbol(F.col("event_id")).alias("id"), role.alias("role"), "user_id")


# The same views for DuckDB, as common table expressions.
SQL = {
    "places": """places AS (
  SELECT 'entity:customer_' || c_custkey AS s, 'locatedIn' AS p, 'entity:' || replace(lower(n_name), ' ', '_') AS o, 0.9::DOUBLE AS conf, c_custkey::BIGINT AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'entity:supplier_' || s_suppkey, 'locatedIn', 'entity:' || replace(lower(n_name), ' ', '_'), 0.8, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'entity:' || replace(lower(n_name), ' ', '_'), 'in', 'entity:' || replace(lower(r_name), ' ', '_'), 1.0, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "pairs": """pairs AS (
  SELECT 'entity:part_' || l_partkey AS s, 'with' AS p, 'entity:supplier_' || l_suppkey AS o, 0.5 + (l_suppkey % 5)::DOUBLE / 10 AS conf, l_partkey * 1000000 + l_suppkey AS seq
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))""",
    "requires": """requires AS (
  SELECT 'entity:order_' || l_orderkey AS s, 'requires' AS p, 'entity:part_' || l_partkey AS o, 0.9::DOUBLE AS conf, l_orderkey * 1000000 + l_partkey AS seq
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))""",
    "attributes": """attributes AS (
  SELECT 'entity:part_' || p_partkey AS s, 'hasAttribute' AS p, 'concept:' || replace(lower(p_brand), ' ', '_') AS o, 0.9::DOUBLE AS conf, p_partkey::BIGINT AS seq FROM part
  UNION ALL SELECT 'entity:customer_' || c_custkey, 'hasAttribute', 'concept:' || replace(lower(c_mktsegment), ' ', '_'), 0.8, c_custkey FROM customer)""",
    "types": """types AS (
  SELECT 'entity:part_' || p_partkey AS id, 'concept:' || replace(lower(p_type), ' ', '_') AS type FROM part
  UNION ALL SELECT 'entity:supplier_' || s_suppkey, 'concept:supplier' FROM supplier
  UNION ALL SELECT 'entity:customer_' || c_custkey, 'concept:person' FROM customer
  UNION ALL SELECT 'entity:' || replace(lower(n_name), ' ', '_'), 'concept:nation' FROM nation
  UNION ALL SELECT 'entity:' || replace(lower(r_name), ' ', '_'), 'concept:region' FROM region)""",
    "subclass": """subclass AS (
  SELECT DISTINCT 'concept:' || replace(lower(p_type), ' ', '_') AS child, 'concept:product' AS parent FROM part
  UNION ALL VALUES ('concept:product', 'concept:thing'), ('concept:person', 'concept:thing'), ('concept:nation', 'concept:place'), ('concept:region', 'concept:place'), ('concept:place', 'concept:thing'))""",
    "ev": """ev AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'evidence_signal' WHEN 'purchase' THEN 'outcome' WHEN 'signup' THEN 'recovery_phase' ELSE 'temporal_marker' END AS role,
  'entity:event_' || event_id AS id FROM events)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
