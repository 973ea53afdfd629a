"""Session memory, order-free knowledge and incremental indexes over streams; each equals a batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import facts
from ..sources.facts import Tables
from ..streaming import ingest, knowledge, session
from .register import Register
from .stream_queries import streamed

query = Register()


def event_rows(events):
    """An event touches an entity; unless it is a view it is a fact; a click answers one of three questions; some signups reset."""
    row = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    bucket = lambda width: F.floor(F.col("value") / width).cast("string")
    none = F.lit(None).cast("string")
    rows = F.array(
        row("entity", none, F.concat_ws("_", "event_type", bucket(10))),
        F.when(F.col("event_type") != "view", row("fact", none, F.concat_ws(" ", F.lit("did"), "event_type", bucket(50)))),
        F.when(F.col("event_type") == "click", row("answer", F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("a"), bucket(20)))),
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), row("reset", none, none)),
    )
    return events.select(F.col("user_id").cast("string").alias("session"), F.explode(F.array_compact(rows)).alias("x"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")).select("session", "x.*", "ts", "seq")


@query(
    "stream_session",
    """WITH every AS (
  SELECT user_id::VARCHAR AS session, 'entity' AS kind, '' AS key, event_type || '_' || floor(value / 10)::BIGINT AS value, ts, event_id AS seq FROM events
  UNION ALL SELECT user_id::VARCHAR, 'fact', '', 'did ' || event_type || ' ' || floor(value / 50)::BIGINT, ts, event_id FROM events WHERE event_type <> 'view'
  UNION ALL SELECT user_id::VARCHAR, 'answer', 'q' || event_id % 3, 'a' || floor(value / 20)::BIGINT, ts, event_id FROM events WHERE event_type = 'click'),
clock AS (SELECT session, max(ts) AS newest FROM every GROUP BY 1),
last_reset AS (
  SELECT user_id::VARCHAR AS session, ts AS r_ts, event_id AS r_seq FROM events WHERE event_type = 'signup' AND event_id % 7 = 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
kept AS (
  SELECT every.* FROM every JOIN clock USING (session) LEFT JOIN last_reset USING (session)
  WHERE ts >= newest - INTERVAL 3 DAY AND (r_ts IS NULL OR ts > r_ts OR ts = r_ts AND seq > r_seq)
  QUALIFY kind = 'fact' OR row_number() OVER (PARTITION BY session, kind, key, value ORDER BY ts DESC, seq DESC) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY session, kind, key ORDER BY ts DESC, seq DESC, value) AS place FROM kept)
SELECT session, kind, key, value, seq, place FROM placed WHERE place <= CASE kind WHEN 'entity' THEN 10 WHEN 'fact' THEN 5 ELSE 3 END""",
)
def stream_session(t: Tables):
    """What each user's session holds at the end of the events: ten entities, five facts, three answers a question."""
    rows = event_rows(streamed(t, "events"))
    held = session.remember(rows, idle=3 * 86_400, late="60 days", entities=10, facts=5, answers=3)
    return held.select("session", "kind", "key", "value", "seq", F.col("place").cast("long").alias("place"))


@query(
    "stream_knowledge",
    """WITH RECURSIVE rules AS (
  SELECT DISTINCT 'hasBrand' AS p, p_brand AS o, 'hasType' AS p2, p_type AS o2, 0.7::DOUBLE AS weight FROM part
  UNION SELECT 'hasType', p_type, 'sizedLike', p_type || ' ' || max(p_size), 0.6 FROM part GROUP BY p_type
  UNION SELECT 'sizedLike', p_type || ' ' || max(p_size), 'hasBrand', min(p_brand), 0.5 FROM part GROUP BY p_type),
reached(s, p, o) AS (
  SELECT 'entity:part_' || p_partkey, 'hasBrand', p_brand FROM part
  UNION SELECT s, p2, o2 FROM reached JOIN rules USING (p, o)),
weighed AS (SELECT s, p2 AS p, o2 AS o, max(weight) AS conf FROM reached JOIN rules USING (p, o) GROUP BY ALL),
told AS (SELECT 'entity:part_' || p_partkey AS s, 'hasBrand' AS p, p_brand AS o, 0.9::DOUBLE AS conf FROM part),
every AS (SELECT * FROM told UNION ALL SELECT * FROM weighed ANTI JOIN told USING (s, p, o))
SELECT s, count(*) AS n, count(*) FILTER (WHERE p = 'sizedLike') AS sizes, count(*) FILTER (WHERE p = 'hasBrand') AS brands, round(sum(conf), 6) AS total FROM every GROUP BY 1""",
)
def stream_knowledge(t: Tables):
    """Facts of odd parts come first, then the rules, then the other facts; what follows is the same as if all had come at once."""
    folder = ingest.shared_folder(t.spark, "arrivals")
    told = facts.fact(t.part, facts.symbol("part", F.col("p_partkey")), "hasBrand", F.col("p_brand"), F.lit(0.9), F.col("p_partkey"))
    odd = F.col("seq") % 2 == 1
    rule = lambda p, o, p2, o2, weight: [F.lit(p).alias("p"), o.alias("o"), F.lit(p2).alias("p2"), o2.alias("o2"), F.lit(weight).alias("weight")]
    types = t.part.groupBy("p_type").agg(F.concat_ws(" ", "p_type", F.max("p_size").cast("string")).alias("size"), F.min("p_brand").alias("brand"))
    rules = facts.union(
        t.part.select(*rule("hasBrand", F.col("p_brand"), "hasType", F.col("p_type"), 0.7)).distinct(), types.select(*rule("hasType", F.col("p_type"), "sizedLike", F.col("size"), 0.6)),
        types.select(*rule("sizedLike", F.col("size"), "hasBrand", F.col("brand"), 0.5)),
    )
    store = knowledge.Knowledge(t.spark)
    rules.limit(0).write.parquet(f"{folder}/rules")
    told.filter(odd).write.parquet(f"{folder}/facts")
    own = t.spark.readStream.schema(told.schema).parquet(f"{folder}/facts")
    recorded = t.spark.readStream.schema(rules.schema).parquet(f"{folder}/rules")
    store.take(own, recorded)
    rules.write.mode("append").parquet(f"{folder}/rules")
    store.take(own, recorded)
    told.filter(~odd).write.mode("append").parquet(f"{folder}/facts")
    got = store.take(own, recorded)
    count = lambda p: F.count_if(F.col("p") == p)
    return got.groupBy("s").agg(F.count("*").alias("n"), count("sizedLike").alias("sizes"), count("hasBrand").alias("brands"), F.round(F.sum("conf"), 6).alias("total"))


WEIGHTS = [("indicates", 0.8), ("reports", 0.4)]


def streamed_facts(t: Tables):
    """Orders require parts, customers are powered by orders, events are during a day and indicate or report their user."""
    lines = streamed(t, "lineitem").select(facts.symbol("order", F.col("l_orderkey")).alias("s"), F.lit("http://example.org/requires").alias("p"), facts.symbol("part", F.col("l_partkey")).alias("o"))
    orders = streamed(t, "orders").select(facts.symbol("customer", F.col("o_custkey")).alias("s"), F.lit("poweredBy").alias("p"), facts.symbol("order", F.col("o_orderkey")).alias("o"))
    event = facts.event_symbol(F.col("event_id"))
    told = F.array(F.struct(F.lit("during").alias("p"), F.concat(F.lit("day:"), F.to_date("ts").cast("string")).alias("o")), F.struct(F.when(F.col("value") > 20, "indicates").otherwise("reports").alias("p"), facts.symbol("user", F.col("user_id")).alias("o")))
    events = streamed(t, "events").select(event.alias("s"), F.explode(told).alias("x")).select("s", "x.*")
    return facts.union(lines, orders, events)


@query(
    "stream_index_entries",
    """WITH told AS (
  SELECT 'entity:order_' || l_orderkey AS s, 'requires' AS p, 'entity:part_' || l_partkey AS o FROM lineitem
  UNION ALL SELECT 'entity:customer_' || o_custkey, 'poweredby', 'entity:order_' || o_orderkey FROM orders
  UNION ALL SELECT 'entity:event_' || event_id, 'during', 'day:' || ts::DATE FROM events
  UNION ALL SELECT 'entity:event_' || event_id, CASE WHEN value > 20 THEN 'indicates' ELSE 'reports' END, 'entity:user_' || user_id FROM events)
SELECT 'postings' AS index, p AS key, count(DISTINCT (s, p, o)) AS members, count(*) AS n, 1.0::DOUBLE AS value FROM told GROUP BY p
UNION ALL SELECT 'dependents', o, count(DISTINCT s), count(*), 1.0 FROM told WHERE p IN ('requires', 'poweredby') GROUP BY o
UNION ALL SELECT 'temporal', x, 1, count(*), 1.0 FROM (SELECT s AS x FROM told WHERE p = 'during' UNION ALL SELECT o FROM told WHERE p = 'during') GROUP BY x
UNION ALL SELECT 'signal', s, 1, count(*), max(CASE p WHEN 'indicates' THEN 0.8 ELSE 0.4 END) FROM told JOIN events ON s = 'entity:event_' || event_id AND event_type = 'click' AND p IN ('indicates', 'reports') GROUP BY s""",
)
def stream_index_entries(t: Tables):
    """Per key of the four indexes its members, the rows that made them and the largest value; clicks are the evidence signals."""
    weights = t.spark.createDataFrame(WEIGHTS, "p string, weight double")
    signals = t.events.filter("event_type = 'click'").select(facts.event_symbol(F.col("event_id")).alias("id"))
    entries = knowledge.Indexes(t.spark).take(streamed_facts(t), weights, signals)
    return entries.groupBy("index", "key").agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.max("value").alias("value"))


@query(
    "stream_labels",
    """WITH labels AS (SELECT 'entity:user_' || user_id AS id, arg_max(event_type || ' in ' || strftime(ts, '%B'), event_id) AS label FROM events GROUP BY 1)
SELECT DISTINCT unnest(string_split(lower(label), ' ')) AS token, id FROM labels""",
)
def stream_labels(t: Tables):
    """Users are called after their last event; earlier names leave no token."""
    own = streamed(t, "events").select(facts.symbol("user", F.col("user_id")).alias("id"), F.concat_ws(" ", "event_type", F.lit("in"), F.date_format("ts", "MMMM")).alias("label"), F.col("event_id").alias("seq"))
    return knowledge.LabelIndex(t.spark).take(own)


QUERIES, ORACLES = query.queries, query.oracles
