"""Chains over composed graphs and explanations with evidence; each edge kind and branch occurs in the results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains
from ..sources import facts
from ..sources.facts import Tables
from .diagnose_queries import EV
from .register import Register

query = Register()

DYNAMIC = [("before", 0.1), ("fail", 0.3), ("indicates", 0.2)]


def day(user, ts):
    return F.concat(F.lit("entity:day_"), user.cast("string"), F.lit("_"), F.to_date(ts).cast("string"))


COMPOSED = EV + """, far AS (SELECT *, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n2 FROM ev),
  edges AS (SELECT s, o, max(w) AS w FROM (
    SELECT id AS s, 'entity:event_' || nxt AS o, 0.85::DOUBLE AS w FROM ev WHERE nxt IS NOT NULL
    UNION ALL SELECT 'concept:event_' || event_id, 'entity:user_' || user_id, 1.3 FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT id, 'entity:day_' || user_id || '_' || ts::DATE, 1.15 FROM ev
    UNION ALL SELECT id, 'entity:event_' || n2, 1.05 FROM far WHERE event_type = 'error' AND n2 IS NOT NULL
    UNION ALL SELECT id, 'concept:event_' || event_id, 0.05 FROM ev WHERE event_type = 'purchase' UNION ALL SELECT 'concept:event_' || event_id, id, 0.05 FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT DISTINCT 'entity:user_' || user_id, 'concept:customer_group_' || user_id % 5, 0.15 FROM ev) GROUP BY 1, 2
  UNION ALL SELECT a.id, b.id, 0.25 FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.ts::DATE = b.ts::DATE AND a.event_id <> b.event_id),
  l0 AS (SELECT event_id AS goal, 'concept:customer_group_' || user_id % 5 AS target, id AS node, 0.0::DOUBLE AS score FROM ev WHERE event_type = 'error'),
  """ + ",\n  ".join(f"l{k} AS (SELECT goal, target, o AS node, max(round(score + w, 9)) AS score FROM l{k - 1} JOIN edges ON node = s WHERE node <> target GROUP BY 1, 2, 3)" for k in range(1, 5))


@query(
    "composed_chain",
    f"""{COMPOSED}, done AS ({" UNION ALL ".join(f"SELECT goal, score, {k} AS hops FROM l{k} WHERE node = target" for k in range(1, 5))})
SELECT goal, round(max(score), 6) AS score, arg_max(hops, (score, -hops)) AS hops FROM done GROUP BY 1""",
)
def composed_chain(t: Tables):
    """From each error to its user's group: over following or bridged events or a rule to a purchase, its concept, the user, its type."""
    event = facts.event_symbol(F.col("event_id"))
    bought = t.events.filter("event_type = 'purchase'")
    indicated = facts.fact(bought, F.regexp_replace(event, "^entity:", "concept:"), "indicates", facts.symbol("user", F.col("user_id")), F.lit(0.8), F.col("event_id"))
    during = facts.fact(t.events, event, "during", day(F.col("user_id"), F.col("ts")), F.lit(0.9), F.col("event_id"))
    told = facts.union(facts.event_order(t), indicated, during)
    second = F.lead("event_id", 2).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fails = lambda s: F.struct(s.alias("s"), F.lit("fail").alias("p"), F.lit("concept:true").alias("o"))
    rules = t.events.withColumn("n2", second).filter("event_type = 'error' AND n2 IS NOT NULL").select(fails(event).alias("ant"), fails(facts.event_symbol(F.col("n2"))).alias("con"))
    group = F.concat(F.lit("concept:customer_group_"), (F.col("user_id") % 5).cast("string"))
    types = t.events.select(facts.symbol("user", F.col("user_id")).alias("id"), group.alias("type")).distinct()
    edges = chains.composed_edges(told, rules, types, t.spark.createDataFrame(DYNAMIC, "p string, weight double"))
    goals = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("goal"), event.alias("start"), group.alias("target"))
    return chains.best_walks(goals, edges, chains.times(told), depth=4).select("goal", F.round("score", 6).alias("score"), "hops")


EXPLAINED = EV + """, back AS (SELECT *, lag(id) OVER w AS prev, lag(event_type) OVER w AS prev_type, lag(value) OVER w AS prev_value FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT id AS effect, prev AS cause, CASE WHEN prev_type = 'error' AND prev_value > 50 THEN 'fact' ELSE 'rule' END AS kind FROM back WHERE prev_type IN ('error', 'click')),
  said AS (SELECT effect, cause, kind, CASE kind WHEN 'fact' THEN cause || ' causes ' || effect ELSE 'if ' || cause || ' then ' || effect END || ' | ' || cause || ' before ' || effect AS said FROM c),
  t AS (SELECT id AS target, prev, nxt FROM back WHERE event_type = 'purchase')"""


@query(
    "evidence_chain",
    f"""{EXPLAINED}
SELECT target, coalesce(concat_ws(' | ', a.said, b.said, d.said), '') AS chain, concat_ws(',', a.kind, b.kind, d.kind) AS kinds, (a.kind IS NOT NULL)::INT + (b.kind IS NOT NULL)::INT + (d.kind IS NOT NULL)::INT AS hops
FROM t JOIN said a ON a.effect = target LEFT JOIN said b ON b.effect = a.cause LEFT JOIN said d ON d.effect = b.cause
UNION ALL SELECT target, concat_ws(' | ', prev || ' before ' || target, target || ' before entity:event_' || nxt), '', 0 FROM t WHERE target NOT IN (SELECT effect FROM c)""",
)
def evidence_chain(t: Tables):
    """Why a purchase: told causes (errors) and rules (after errors and clicks), which win where they weigh the same, with what came before what."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    each = t.events.withColumn("prev", F.lag(F.struct("event_id", "event_type", "value")).over(own)).filter("prev IS NOT NULL")
    effect, cause = facts.event_symbol(F.col("event_id")), facts.event_symbol(F.col("prev.event_id"))
    score = F.round(F.col("prev.value") / 1000, 3)

    def candidates(kind, types, score, line):
        return each.filter(F.col("prev.event_type").isin(*types)).select(effect.alias("effect"), cause.alias("cause"), F.lit(kind).alias("kind"), score.alias("score"), F.col("event_id").alias("seq"), line.alias("line"))

    told = candidates("fact", ["error"], score + F.when(F.col("prev.value") > 50, 0.1).otherwise(0.0), F.concat_ws(" causes ", cause, effect))
    ruled = candidates("rule", ["error", "click"], score, F.concat(F.lit("if "), cause, F.lit(" then "), effect))
    targets = t.events.filter("event_type = 'purchase'").select(effect.alias("target"))
    got = chains.explained(told.unionByName(ruled), facts.event_order(t), targets, depth=3)
    return got.select("target", F.array_join("lines", " | ").alias("chain"), "kinds", "hops")


QUERIES, ORACLES = query.queries, query.oracles
