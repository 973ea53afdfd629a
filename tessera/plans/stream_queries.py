"""Streaming queries; each equals a batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query as ask
from ..operators import rules, scoring
from ..sources import facts
from ..sources.facts import SQL, Tables, with_views
from ..streaming import ingest
from .register import Register

query = Register()


def streamed(t: Tables, name: str):
    return ingest.stream_table(t.spark, f"{t.folder}/{name}.parquet")


@query("stream_ingest", "SELECT 'entity:user_' || user_id AS s, 'did' AS p, 'concept:' || event_type AS o, arg_min(value, (event_id, -value)) AS conf FROM events GROUP BY 1, 3")
def stream_ingest(t: Tables):
    """Each (user, event type) is a fact, recorded when it first occurs."""
    own = streamed(t, "events").select(facts.symbol("user", F.col("user_id")).alias("s"), F.lit("did").alias("p"), F.concat(F.lit("concept:"), "event_type").alias("o"), F.col("value").alias("conf"), F.col("event_id").alias("seq"))
    return ingest.ingest_facts(own).select("s", "p", "o", "conf")


@query("stream_rules", "SELECT DISTINCT 'Brand' AS ant, p_brand AS name, p_type AS con FROM part")
def stream_rules(t: Tables):
    own = streamed(t, "part").select(F.lit("Brand").alias("ant"), F.col("p_brand").alias("name"), F.col("p_type").alias("con"))
    return ingest.ingest_rules(own, ["ant", "name", "con"])


@query(
    "stream_rule_closure",
    """WITH told AS (SELECT 'entity:part_' || p_partkey AS s, 'hasBrand' AS p, p_brand AS o, 0.9::DOUBLE AS conf FROM part),
  r AS (SELECT DISTINCT 'hasBrand' AS p, p_brand AS o, 'hasType' AS p2, p_type AS o2, 0.7::DOUBLE AS weight FROM part UNION SELECT DISTINCT 'hasType', p_type, 'sizedLike', p_type || ' ' || max(p_size), 0.6::DOUBLE FROM part GROUP BY p_type),
  d1 AS (SELECT DISTINCT s, p2 AS p, o2 AS o, weight AS conf FROM told JOIN r USING (p, o)), d2 AS (SELECT DISTINCT s, p2 AS p, o2 AS o, weight AS conf FROM d1 JOIN r USING (p, o))
SELECT s, count(*) AS n, count(*) FILTER (WHERE p = 'sizedLike') AS second, min(o) FILTER (WHERE p = 'hasType') AS first, round(sum(conf), 6) AS total FROM (FROM told UNION ALL FROM d1 UNION ALL FROM d2) GROUP BY 1""",
)
def stream_rule_closure(t: Tables):
    """Rules recorded from one stream are applied to the facts of a later one, as they come."""
    told = streamed(t, "part").select(F.lit("hasBrand").alias("p"), F.col("p_brand").alias("o"), F.lit("hasType").alias("p2"), F.col("p_type").alias("o2"), F.lit(0.7).alias("weight"))
    sizes = t.part.groupBy("p_type").agg(F.max("p_size").alias("size")).select(F.lit("hasType").alias("p"), F.col("p_type").alias("o"), F.lit("sizedLike").alias("p2"), F.concat_ws(" ", "p_type", F.col("size").cast("string")).alias("o2"), F.lit(0.6).alias("weight"))
    recorded = ingest.ingest_rules(told, ["p", "o", "p2", "o2"]).unionByName(sizes)
    own = facts.fact(streamed(t, "part"), facts.symbol("part", F.col("p_partkey")), "hasBrand", F.col("p_brand"), F.lit(0.9), F.col("p_partkey"))
    got = ingest.ingest_facts(own, keep=lambda new: rules.close_kinds(new, recorded))
    return got.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("p") == "sizedLike").alias("second"), F.min(F.when(F.col("p") == "hasType", F.col("o"))).alias("first"), F.round(F.sum("conf"), 6).alias("total"))


@query("stream_indexes", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_indexes(t: Tables):
    return ingest.index_counts(streamed(t, "events"), ["event_type", "user_id"])


@query("stream_memory", "SELECT conv_id, least(count(DISTINCT text), 50) AS remembered, max(turn) AS last_turn FROM conversations GROUP BY 1")
def stream_memory(t: Tables):
    return ingest.session_memory(streamed(t, "conversations"))


@query("stream_answers", with_views("places") + " SELECT c_custkey AS goal_id, o AS answer FROM customer JOIN places ON s = 'entity:customer_' || c_custkey")
def stream_answers(t: Tables):
    goals = streamed(t, "customer").select(F.col("c_custkey").alias("goal_id"), facts.symbol("customer", F.col("c_custkey")).alias("subject"), F.lit("locatedIn").alias("predicate"))
    return ingest.answer_stream(goals, facts.places(t))


@query("user_head", "WITH " + SQL["pairs"] + ", " + SQL["attributes"] + " SELECT producer, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT 'with' AS producer, conf AS score FROM pairs UNION ALL SELECT 'attribute', (conf + 0.6) / 2 FROM attributes WHERE s LIKE 'entity:part%') GROUP BY 1")
def user_head(t: Tables):
    """Heads are functions from facts to candidates; their outputs are one table."""
    def with_head(own):
        return own.filter("p = 'with'").select(F.col("s").alias("goal_id"), F.col("o").alias("answer"), F.col("conf").alias("score"), F.lit("with").alias("producer"))

    def attribute_head(own):
        goals = t.part.select(facts.symbol("part", F.col("p_partkey")).alias("subject")).withColumn("goal_id", F.col("subject"))
        return ask.attribute_query(goals, own, ["hasAttribute"]).select("goal_id", "answer", F.col("head_score").alias("score"), F.lit("attribute").alias("producer"))

    own = facts.union(facts.part_with_supplier(t), facts.attributes(t))
    every = facts.union(*[head(own) for head in (with_head, attribute_head)])
    return scoring.rank(every).groupBy("producer").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


QUERIES, ORACLES = query.queries, query.oracles
