"""Diagnostic queries: failures, causes, support, dependencies, chains; over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import diagnose as dia
from ..operators import chains, ontology, paths
from ..operators.rules import chain_ends
from ..sources import facts
from ..sources.facts import Tables, with_views
from . import answer_queries
from .register import Register

query = Register()

EV = with_views("ev")


def roles(t: Tables):
    return facts.event_types(t).select("id", "role")


def weights(t: Tables):
    """Evidence weights of predicates."""
    return t.spark.createDataFrame([("before", 0.25), ("cause", 0.5)], "p string, weight double")


def timeline(t: Tables):
    return facts.union(facts.event_order(t), facts.event_causes(t))


@query("failures", EV + " SELECT id AS s FROM ev WHERE event_type = 'error'")
def failures(t: Tables):
    return dia.failures(facts.union(facts.event_failures(t), facts.event_order(t)))


@query("subsystem_failures", EV + " SELECT id AS s FROM ev WHERE event_type = 'error' UNION SELECT 'entity:event_' || nxt FROM ev WHERE nxt IS NOT NULL UNION SELECT id FROM ev WHERE nxt IS NOT NULL")
def subsystem_failures(t: Tables):
    """Failures in facts or on a side of a rule."""
    from .rule_queries import ground_rules

    sides = ground_rules(t)
    return dia.subsystem_failures(facts.event_failures(t), sides)


@query("capability_losses", "SELECT 'entity:event_' || event_id AS s FROM events WHERE event_type = 'view' AND value < 10")
def capability_losses(t: Tables):
    """Views of little value stand for lost control."""
    flag = F.when(F.col("value") < 10, "concept:false").otherwise("concept:true")
    own = facts.fact(t.events.filter("event_type = 'view'"), facts.event_symbol(F.col("event_id")), "control", flag, F.lit(0.9), F.col("event_id"))
    return dia.capability_losses(own)


@query("signals", EV + " SELECT id AS signal, 'entity:event_' || nxt AS target, CASE WHEN event_type = 'error' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM ev WHERE nxt IS NOT NULL")
def signals(t: Tables):
    return dia.precursors(timeline(t), weights(t)).select("signal", "target", "weight")


@query("signal_weights", EV + " SELECT id AS s, CASE WHEN event_type = 'error' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM ev WHERE nxt IS NOT NULL")
def signal_weights(t: Tables):
    return dia.signal_weights(timeline(t), weights(t))


RECOVERY = EV + """, n AS (SELECT event_id AS k, role AS next_role FROM ev) SELECT id AS s, 'entity:event_' || nxt AS o, role NOT IN ('evidence_signal', 'temporal_marker') AS is_agent FROM ev JOIN n ON nxt = k WHERE next_role = 'recovery_phase'"""


@query("recovery_agents", RECOVERY)
def recovery_agents(t: Tables):
    return dia.recovery(facts.event_order(t), roles(t)).select("s", "o", "is_agent")


@query("outcomes", EV + ", n AS (SELECT event_id AS k, role AS r2 FROM ev) SELECT 'entity:event_' || nxt AS o FROM ev JOIN n ON nxt = k WHERE event_type = 'error' AND r2 = 'outcome'")
def outcomes(t: Tables):
    return dia.outcomes(facts.event_causes(t), roles(t))


@query("temporal_context", EV + " SELECT id AS node FROM ev WHERE nxt IS NOT NULL UNION SELECT 'entity:event_' || nxt FROM ev WHERE nxt IS NOT NULL")
def temporal_context(t: Tables):
    return dia.temporal_nodes(facts.event_order(t))


@query("temporal_support", EV + " SELECT id AS cause, 'entity:event_' || nxt AS effect, 0.8::DOUBLE AS support FROM ev WHERE event_type = 'error' AND nxt IS NOT NULL")
def temporal_support(t: Tables):
    """A cause edge and a before edge between the same two events: 0.4 each."""
    pairs = facts.event_causes(t).select(F.col("s").alias("cause"), F.col("o").alias("effect"))
    return dia.temporal_support(pairs, timeline(t)).withColumn("support", F.round("support", 6))


TELEMETRY = """tele AS (SELECT node, sum(w) AS support FROM (
  SELECT id AS node, 0.25::DOUBLE AS w FROM ev WHERE nxt IS NOT NULL UNION ALL SELECT 'entity:event_' || nxt, 0.25 FROM ev WHERE nxt IS NOT NULL
  UNION ALL SELECT id, 0.5 FROM ev WHERE nxt IS NOT NULL AND event_type = 'error' UNION ALL SELECT 'entity:event_' || nxt, 0.5 FROM ev WHERE nxt IS NOT NULL AND event_type = 'error') GROUP BY 1)"""


@query("telemetry_support", f"{EV}, {TELEMETRY} SELECT node, round(support, 6) AS support FROM tele")
def telemetry_support(t: Tables):
    return dia.telemetry_support(timeline(t), weights(t)).withColumn("support", F.round("support", 6))


CAUSES = f"{EV}, {TELEMETRY}, causes AS (SELECT id AS cause, 'entity:event_' || nxt AS effect, 0.75 + 0.8 + support + 0.1 AS score FROM ev JOIN tele ON node = id WHERE event_type = 'error' AND nxt IS NOT NULL)"


def scores(t: Tables):
    dynamic = t.spark.createDataFrame([("cause", 0.1)], "p string, weight double")
    return dia.cause_scores(facts.event_causes(t), timeline(t), weights(t), dynamic)


@query("cause_score", f"{CAUSES} SELECT cause, effect, round(score, 6) AS score FROM causes")
def cause_score(t: Tables):
    """Specificity (an event has two tokens, one of them a container word: 0.75), support, telemetry, dynamic weight."""
    return scores(t).select("cause", "effect", F.round("score", 6).alias("score"))


@query("annotation_weights", f"{CAUSES} SELECT round(avg(score), 4) AS mean, count(*) AS n FROM causes")
def annotation_weights(t: Tables):
    """Weights come from annotation rows, given as text and cast."""
    notes = weights(t).select("p", F.col("weight").cast("string").alias("value"))
    read = notes.select("p", F.expr("try_cast(value AS double)").alias("weight"))
    dynamic = t.spark.createDataFrame([("cause", 0.1)], "p string, weight double")
    got = dia.cause_scores(facts.event_causes(t), timeline(t), read, dynamic)
    return got.agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


@query("hop_evidence", EV + " SELECT id AS cause, 'entity:event_' || nxt AS effect, 1::BIGINT AS n, id || ' before ' || 'entity:event_' || nxt AS first FROM ev WHERE event_type = 'error' AND nxt IS NOT NULL")
def hop_evidence(t: Tables):
    """Temporal facts between a cause and its effect."""
    hops = facts.event_causes(t).select(F.col("s").alias("cause"), F.col("o").alias("effect"))
    timed = facts.event_order(t).filter(F.col("p").isin(dia.TEMPORAL))
    there = hops.join(timed, (F.col("cause") == F.col("s")) & (F.col("effect") == F.col("o")))
    back = hops.join(timed, (F.col("effect") == F.col("s")) & (F.col("cause") == F.col("o")))
    return there.unionByName(back).groupBy("cause", "effect").agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "s", "p", "o")).alias("first"))


ALIGN = EV + """, f AS (SELECT user_id, event_id, id, value FROM ev WHERE event_type = 'error'),
  g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views FROM ev GROUP BY 1),
  al AS (SELECT user_id AS goal, id AS failure, 0.6 * (value / 1000) + 0.4 * (clicks / 1000.0::DOUBLE) + 0.4 * (value / 2000) + 0.2 * (views / 1000.0::DOUBLE) AS score FROM f JOIN g USING (user_id))"""


def aligned(t: Tables):
    """Each user's errors as failures; the strength of signals follows from the error's value and the user's clicks and views."""
    users = t.events.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"))
    own = t.events.filter("event_type = 'error'").select("user_id", facts.event_symbol(F.col("event_id")).alias("failure"), "value").join(users, "user_id").withColumnRenamed("user_id", "goal")
    signals_ = own.select("goal", "failure", (F.col("value") / 1000).alias("to_failure"), (F.col("clicks") / 1000).alias("to_outcome"))
    nodes = own.select("goal", "failure", (F.col("value") / 2000).alias("to_failure"), (F.col("views") / 1000).alias("to_outcome"))
    return dia.evidence_alignment(signals_, nodes).withColumn("score", F.round("score", 9))


@query("evidence_alignment", f"{ALIGN} SELECT goal, failure, round(round(score, 9), 6) AS score FROM al")
def evidence_alignment(t: Tables):
    return aligned(t).withColumn("score", F.round("score", 6))


@query("ruled_out", f"{ALIGN}, b AS (SELECT goal, failure, round(score, 9) AS score, max(round(score, 9)) OVER (PARTITION BY goal) AS best FROM al) SELECT goal, failure FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score, failure) AS n FROM b WHERE best < 0.3 AND score < 0.2) WHERE n <= 3")
def ruled_out(t: Tables):
    return dia.ruled_out(aligned(t)).select("goal", "failure")


@query("root_failure", EV + " SELECT user_id AS goal, min(id) FILTER (WHERE event_type = 'error') AS failure FROM ev WHERE event_type = 'error' GROUP BY 1")
def root_failure(t: Tables):
    """All of a user's errors are as specific and in time; the least name is the root."""
    own = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("goal"), facts.event_symbol(F.col("event_id")).alias("failure"))
    every = t.events.select(facts.event_symbol(F.col("event_id")).alias("node"))
    return dia.root_failure(own, every).select("goal", "failure")


@query("dependents", with_views("requires") + " SELECT o AS resource, count(*) AS n, min(s) AS first FROM requires GROUP BY 1")
def dependents(t: Tables):
    return dia.dependents(facts.order_requires(t)).groupBy("resource").agg(F.count("*").alias("n"), F.min("dependent").alias("first"))


@query(
    "survivors",
    "WITH d AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT 'entity:order_' || l_orderkey AS dependent FROM d GROUP BY l_orderkey HAVING bool_or(p_brand LIKE 'Brand#1%') AND NOT bool_or(p_brand LIKE 'Brand#5%')",
)
def survivors(t: Tables):
    """Orders that need a part of maker 1 and none of maker 5."""
    of = lambda maker: t.part.filter(F.col("p_brand").startswith(f"Brand#{maker}")).select(facts.symbol("part", F.col("p_partkey")).alias("resource"))
    return dia.survivors(dia.dependents(facts.order_requires(t)), of(1), of(5))


@query("dependency_contrast", with_views("requires", "pairs") + " SELECT r.s AS dependent, count(DISTINCT x.o) AS suppliers, count(DISTINCT r.o) AS parts FROM requires r JOIN pairs x ON r.o = x.s GROUP BY 1")
def dependency_contrast(t: Tables):
    """What an order depends on, directly and one step further.

    Keys stay numbers until the counts are made, and the suppliers of a part are listed once.
    """
    return contrasts(t, t.lineitem)


def contrasts(t: Tables, lines):
    """`dependency_contrast` of the orders that have `lines`."""
    direct = lines.select("l_orderkey", "l_partkey").distinct()
    parts = direct.groupBy("l_orderkey").agg(F.count("*").alias("parts"))
    ends = chain_ends(lines.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")), t.lineitem.select(F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c")))
    suppliers = ends.groupBy(F.col("a").alias("l_orderkey")).agg(F.sum(F.size("ends").cast("long")).alias("suppliers"))
    return suppliers.join(parts, "l_orderkey").select(facts.symbol("order", F.col("l_orderkey")).alias("dependent"), "suppliers", "parts")


@query("condition_contrast", with_views("requires") + " SELECT o AS resource, arg_min(s, seq) AS first, arg_max(s, seq) AS last FROM requires GROUP BY 1")
def condition_contrast(t: Tables):
    """The first and the last order that depends on each part."""
    return facts.order_requires(t).groupBy(F.col("o").alias("resource")).agg(F.min_by("s", "seq").alias("first"), F.max_by("s", "seq").alias("last"))


@query(
    "resource_availability",
    "SELECT 'entity:part_' || l_partkey AS node, CASE arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_returnflag IN ('A', 'R')) WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS state FROM lineitem GROUP BY l_partkey",
)
def resource_availability(t: Tables):
    """Parts by the first line that was accepted (available) or returned (unavailable)."""
    kind = F.when(F.col("l_returnflag") == "A", "available").when(F.col("l_returnflag") == "R", "unavailable").otherwise("sold")
    own = t.lineitem.select(facts.symbol("part", F.col("l_partkey")).alias("s"), kind.alias("p"), F.lit("concept:true").alias("o"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return dia.availability(own)


@query(
    "backup_lookup",
    """SELECT 'entity:part_' || p_partkey AS part, coalesce(r.s, a.s) AS backup, CASE WHEN r.s IS NOT NULL THEN 0 ELSE 1 END AS tier FROM part
LEFT JOIN (SELECT l_partkey, 'entity:supplier_' || min(CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, 'entity:supplier_' || min(CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey WHERE coalesce(r.s, a.s) IS NOT NULL""",
)
def backup_lookup(t: Tables):
    """Who can stand in for a part's supplier: first of those with returns, else any."""
    sold = t.lineitem.select(facts.symbol("part", F.col("l_partkey")).alias("part"), facts.symbol("supplier", F.col("l_suppkey")).alias("backup"), "l_returnflag")
    return dia.first_of_tiers([sold.filter("l_returnflag = 'R'"), sold], ["part"], "backup")


NATION_SQL = "np AS (SELECT 'entity:' || replace(lower(n_name), ' ', '_') AS n, 'entity:' || replace(lower(r_name), ' ', '_') AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    "relationship_path",
    f"""{EV}, {NATION_SQL}, far AS (SELECT id, event_type, nxt, lead(event_id, 2) OVER w AS n2, lead(event_id, 3) OVER w AS n3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT x.n AS a, y.n AS b, x.n || ' > ' || x.r || ' > ' || y.n AS path, 2 AS hops FROM np x JOIN np y ON x.r = y.r AND x.n < y.n
UNION ALL SELECT id, 'entity:event_' || n3, id || ' > entity:event_' || nxt || ' > entity:event_' || n2 || ' > entity:event_' || n3, 3 FROM far WHERE event_type = 'error' AND n3 IS NOT NULL""",
)
def relationship_path(t: Tables):
    """Nations of one region are joined through it, those of two not at all; an error is joined with the third event after it."""
    return chains.meeting_paths(*related(t))


def related(t: Tables):
    """The edges of `relationship_path` and its pairs (a, b)."""
    own = facts.nation_places(t)
    names = own.select("s")
    pairs = names.select(F.col("s").alias("a")).join(names.select(F.col("s").alias("b")), F.col("a") < F.col("b"))  # 25 nations
    third = F.lead("event_id", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    later = t.events.select("event_type", facts.event_symbol(F.col("event_id")).alias("a"), facts.event_symbol(third).alias("b")).filter("event_type = 'error' AND b IS NOT NULL")
    return own.unionByName(facts.event_order(t)), pairs.unionByName(later.select("a", "b"))


CHAIN_SQL = EV + """, e AS (SELECT id AS s, 'entity:event_' || nxt AS o, round(value / 1000, 3) - 0.1 AS w FROM ev WHERE nxt IS NOT NULL),
  st AS (SELECT id FROM ev WHERE event_type = 'error'),
  p1 AS (SELECT s AS start, o AS node, w AS score, 1 AS hops FROM e WHERE s IN (FROM st)), p2 AS (SELECT start, o AS node, score + w AS score, 2 AS hops FROM p1 JOIN e ON node = s),
  p3 AS (SELECT start, o AS node, score + w AS score, 3 AS hops FROM p2 JOIN e ON node = s), ch AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)"""


def weighted(t: Tables):
    value = t.events.select(facts.event_symbol(F.col("event_id")).alias("s"), (F.round(F.col("value") / 1000, 3) - 0.1).alias("w"))
    return facts.event_order(t).select("s", "o").join(value, "s")


def errors(t: Tables, name: str):
    return t.events.filter("event_type = 'error'").select(facts.event_symbol(F.col("event_id")).alias(name))


@query("forward_best_path", f"{CHAIN_SQL} SELECT start, node, round(score, 6) + 0.0 AS score, hops FROM ch")
def forward_best_path(t: Tables):
    """From each error along the following events, three steps at most; weights may be negative."""
    return paths.best_chains(weighted(t), errors(t, "start"), depth=3).select("start", "node", (F.round("score", 6) + 0.0).alias("score"), "hops")


@query("failure_path", f"{CHAIN_SQL}, u AS (SELECT user_id, id FROM ev) SELECT user_id AS goal, round(max(round(score, 9)), 6) AS score FROM ch JOIN u ON start = id GROUP BY 1")
def failure_path(t: Tables):
    """The best chain from any of a user's failures."""
    chains = paths.best_chains(weighted(t), errors(t, "start"), depth=3)
    users = t.events.select(facts.event_symbol(F.col("event_id")).alias("start"), F.col("user_id").alias("goal"))
    return chains.join(users, "start").groupBy("goal").agg(F.round(F.max("score"), 6).alias("score"))


@query("alias_best_path", f"{CHAIN_SQL} SELECT replace(start, 'entity:', 'concept:') AS subject, replace(node, 'entity:', 'concept:') AS target, hops, round(score, 6) + 0.0 AS score FROM ch WHERE hops > 1")
def alias_best_path(t: Tables):
    """Both ends given by their concept names: of all pairs of their aliases the best chain."""
    after = facts.event_order(t).select("s", "o")
    second = after.join(after.select(F.col("s").alias("o"), F.col("o").alias("two")), "o")
    third = second.join(after.select(F.col("s").alias("two"), F.col("o").alias("three")), "two", "left")
    ends = errors(t, "s").join(third, "s").select("s", F.explode(F.array_compact(F.array("two", "three"))).alias("o"))
    concept = lambda c: F.regexp_replace(c, "^entity:", "concept:")
    pairs = ends.select(concept("s").alias("subject"), concept("o").alias("target"))
    known = t.events.select(facts.event_symbol(F.col("event_id")).alias("alias"))

    def known_as(name):
        return pairs.select(name).distinct().select(name, F.explode(ontology.alias_keys(F.col(name))).alias("alias")).join(known, "alias", "left_semi").distinct()

    starts = known_as("subject").withColumnRenamed("alias", "start")
    got = paths.best_chains(weighted(t), starts.select("start").distinct(), depth=3)
    every = pairs.join(starts, "subject").join(known_as("target").withColumnRenamed("alias", "node"), "target").join(got, ["start", "node"])
    best = every.groupBy("subject", "target").agg(F.max(F.struct("score", (-F.col("hops")).alias("less"))).alias("x"))
    return best.select("subject", "target", (-F.col("x.less")).alias("hops"), (F.round("x.score", 6) + 0.0).alias("score"))


BACK_SQL = EV + """, c AS (SELECT id AS cause, 'entity:event_' || nxt AS effect FROM ev WHERE nxt IS NOT NULL), t AS (SELECT id AS target FROM ev WHERE event_type = 'purchase'),
  a1 AS (SELECT target, cause AS node, 1 AS dist FROM t JOIN c ON target = effect), a2 AS (SELECT target, c.cause AS node, 2 AS dist FROM a1 JOIN c ON node = effect), a3 AS (SELECT target, c.cause AS node, 3 AS dist FROM a2 JOIN c ON node = effect)"""


@query("rule_ancestry", f"{BACK_SQL} SELECT target, arg_max(node, dist) AS cause, max(dist) AS dist FROM (FROM a1 UNION ALL FROM a2 UNION ALL FROM a3) GROUP BY 1")
def rule_ancestry(t: Tables):
    """Backwards from each purchase over what came before, three steps."""
    causes = facts.event_order(t).select(F.col("s").alias("cause"), F.col("o").alias("effect"))
    targets = t.events.filter("event_type = 'purchase'").select(facts.event_symbol(F.col("event_id")).alias("target"))
    return paths.ancestry(causes, targets)


@query(
    "explanation_chain",
    f"{BACK_SQL} SELECT t.target, concat_ws(' < ', t.target, a1.node, a2.node, a3.node) AS chain, (a1.node IS NOT NULL)::INT + (a2.node IS NOT NULL)::INT + (a3.node IS NOT NULL)::INT AS hops FROM t LEFT JOIN a1 USING (target) LEFT JOIN a2 USING (target) LEFT JOIN a3 USING (target)",
)
def explanation_chain(t: Tables):
    causes = facts.event_order(t).select(F.col("s").alias("cause"), F.col("o").alias("effect"), F.col("conf").alias("score"))
    targets = t.events.filter("event_type = 'purchase'").select(facts.event_symbol(F.col("event_id")).alias("target"))
    return paths.explanation(causes, targets, depth=3)


ROLE_LIST = """SELECT user_id AS goal, string_agg(line, ' | ' ORDER BY o, k) AS chain, count(*) AS n FROM (
  SELECT user_id, o, k, line, row_number() OVER (PARTITION BY user_id, o ORDER BY k) AS n FROM (
    SELECT user_id, event_id AS k, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS o, event_type || ' ' || event_id AS line FROM events WHERE event_type <> 'view')) WHERE n <= 2 GROUP BY 1"""


@query("structured_chain", ROLE_LIST)
def structured_chain(t: Tables):
    """Per user: precursors, failures, outcomes, recovery; two of each role at most, in order."""
    from pyspark.sql import Window

    order = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4)
    rows = t.events.filter("event_type <> 'view'").select(F.col("user_id").alias("goal"), order.alias("o"), F.col("event_id").alias("k"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("goal", "o").orderBy("k"))).filter("n <= 2")
    each = first.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("o", "k", "line"))).alias("all"))
    return each.select("goal", F.array_join(F.transform("all", lambda x: x["line"]), " | ").alias("chain"), F.size("all").cast("long").alias("n"))


@query("predicate_explanation", with_views("requires", "pairs") + " SELECT subject, string_agg(line, '; ' ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tier, line) AS n FROM (SELECT o AS subject, 0 AS tier, s || ' requires ' || o AS line FROM requires UNION ALL SELECT s, 1, s || ' with ' || o FROM pairs)) WHERE n <= 3 GROUP BY 1")
def predicate_explanation(t: Tables):
    """Three lines per part: who requires it, then who it is with."""
    from pyspark.sql import Window

    line = F.concat_ws(" ", "s", "p", "o").alias("line")
    both = facts.order_requires(t).select(F.col("o").alias("subject"), F.lit(0).alias("tier"), line).unionByName(facts.part_with_supplier(t).select(F.col("s").alias("subject"), F.lit(1).alias("tier"), line))
    own = both.withColumn("n", F.row_number().over(Window.partitionBy("subject").orderBy("tier", "line"))).filter("n <= 3")
    each = own.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all"))
    return each.select("subject", F.array_join(F.transform("all", lambda x: x["line"]), "; ").alias("lines"))


@query("specificity", "SELECT p_name AS name, round(1.0 + 0.1, 6)::DOUBLE AS entity, round(0.5 + 0.1, 6)::DOUBLE AS concept, FALSE AS loss FROM part GROUP BY 1")
def specificity(t: Tables):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return t.part.select(
        F.col("p_name").alias("name"), F.round(exprs.specificity(F.concat(F.lit("entity:"), name)), 6).alias("entity"), F.round(exprs.specificity(F.concat(F.lit("concept:"), name)), 6).alias("concept"), exprs.has_loss(name).alias("loss")
    ).distinct()


@query("top_specific", "SELECT p_brand AS brand, name, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name) AS place FROM (SELECT DISTINCT p_brand, 'entity:' || replace(p_name, ' ', '_') AS name FROM part)) WHERE place <= 2")
def top_specific(t: Tables):
    from ..operators import scoring

    rows = t.part.select(F.col("p_brand").alias("brand"), facts.named(F.col("p_name")).alias("name")).distinct()
    return scoring.top_specific(rows, "brand", "name", 2, without_losses=True).select("brand", "name", "place")


@query("vocabulary", with_views("places", "pairs", "requires") + " SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'predicate' AS kind, lower(p) AS x FROM (SELECT p FROM places UNION SELECT p FROM pairs UNION SELECT p FROM requires) UNION ALL SELECT DISTINCT 'symbol', x FROM (SELECT s AS x FROM places UNION SELECT o FROM places UNION SELECT s FROM pairs UNION SELECT o FROM pairs UNION SELECT s FROM requires UNION SELECT o FROM requires)) GROUP BY 1")
def vocabulary(t: Tables):
    own = facts.union(facts.places(t), facts.part_with_supplier(t), facts.order_requires(t))
    predicates = own.select(F.lit("predicate").alias("kind"), exprs.local_name(F.col("p")).alias("x")).distinct()
    symbols = own.select(F.lit("symbol").alias("kind"), F.explode(F.array("s", "o")).alias("x")).distinct()
    return predicates.union(symbols).groupBy("kind").agg(F.count("*").alias("n"))


def branches_sql(goals: str, branches: list[tuple[str | None, str]]) -> str:
    """Goals (goal, cue) answered by the first branch (goal, answer) that speaks to their cue."""
    every = " UNION ALL ".join(f"SELECT goal, answer, {tier} AS tier FROM ({sql}) JOIN goals USING (goal)" + (f" WHERE cue = '{cue}'" if cue else "") for tier, (cue, sql) in enumerate(branches))
    return f"WITH goals AS ({goals}) SELECT goal, arg_min(answer, (tier, answer)) AS answer, min(tier) AS tier FROM ({every}) GROUP BY 1"


def goals(t: Tables):
    """(goal, cue): parts, events, orders, nations and users, each asked in one way."""
    cue = lambda key, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int")).alias("cue")
    return facts.union(
        t.part.select(facts.symbol("part", F.col("p_partkey")).alias("goal"), cue(F.col("p_partkey"), "backup", "dependents", "condition", "why")),
        t.events.select(facts.event_symbol(F.col("event_id")).alias("goal"), cue(F.col("event_id"), "signal", "why")),
        t.orders.select(facts.symbol("order", F.col("o_orderkey")).alias("goal"), cue(F.col("o_orderkey"), "contrast", "survivors", "why")),
        t.nation.select(facts.named(F.col("n_name")).alias("goal"), F.lit("relation").alias("cue")),
        t.events.select(facts.symbol("user", F.col("user_id")).alias("goal"), cue(F.col("user_id"), "ruled_out", "why")).distinct(),
    )


GOALS_SQL = """SELECT 'entity:part_' || p_partkey AS goal, ['backup', 'dependents', 'condition', 'why'][p_partkey % 4 + 1] AS cue FROM part UNION ALL SELECT 'entity:event_' || event_id, ['signal', 'why'][event_id % 2 + 1] FROM events
UNION ALL SELECT 'entity:order_' || o_orderkey, ['contrast', 'survivors', 'why'][o_orderkey % 3 + 1] FROM orders UNION ALL SELECT 'entity:' || replace(lower(n_name), ' ', '_'), 'relation' FROM nation
UNION ALL SELECT DISTINCT 'entity:user_' || user_id, ['ruled_out', 'why'][user_id % 2 + 1] FROM events"""


def lookups(t: Tables, asked, only: tuple[str, ...] | None = None) -> dict:
    """Answers (goal, answer) that both dispatches choose from.

    Paths are searched, and suppliers counted, only for those that `asked` (goal, cue) asks for them; of a part's lines only the first is made.
    With `only` no other branch is begun: searches write their rounds, whether their answers are read or not.
    """
    user = facts.symbol("user", F.col("goal")).alias("goal")
    of = lambda cue: asked.filter(F.col("cue") == cue)
    edges, pairs = related(t)
    orders = of("contrast").select(F.regexp_extract("goal", r"^entity:order_(\d+)$", 1).try_cast("long").alias("l_orderkey"))
    line = F.concat_ws(" ", "s", "p", "o").alias("line")
    lines = facts.order_requires(t).select(F.col("o").alias("goal"), F.lit(0).alias("tier"), line).unionByName(facts.part_with_supplier(t).select(F.col("s").alias("goal"), F.lit(1).alias("tier"), line))
    every = {
        "backup": lambda: backup_lookup(t).join(resource_availability(t).filter("state = -1"), F.col("part") == F.col("node"), "left_semi").select(F.col("part").alias("goal"), F.col("backup").alias("answer")),
        "signal": lambda: signals(t).filter("weight > 0.4").select(F.col("target").alias("goal"), F.col("signal").alias("answer")),
        "dependents": lambda: dependents(t).select(F.col("resource").alias("goal"), F.col("first").alias("answer")),
        "relation": lambda: chains.meeting_paths(edges, pairs.join(of("relation").select(F.col("goal").alias("a")), "a", "left_semi")).select(F.col("a").alias("goal"), F.col("path").alias("answer")),
        "ruled_out": lambda: ruled_out(t).select(user, F.col("failure").alias("answer")),
        "contrast": lambda: contrasts(t, t.lineitem.join(orders, "l_orderkey", "left_semi")).select(F.col("dependent").alias("goal"), F.concat_ws(" of ", F.col("suppliers").cast("string"), F.col("parts").cast("string")).alias("answer")),
        "condition": lambda: condition_contrast(t).select(F.col("resource").alias("goal"), F.concat_ws(" to ", "first", "last").alias("answer")),
        "predicate": lambda: lines.groupBy("goal").agg(F.min(F.struct("tier", "line"))["line"].alias("answer")),
        "structured": lambda: structured_chain(t).select(user, F.col("chain").alias("answer")),
        "forward": lambda: forward_best_path(t).groupBy(F.col("start").alias("goal")).agg(F.max_by("node", F.struct("score", "node")).alias("answer")),
        "ancestry": lambda: rule_ancestry(t).select(F.col("target").alias("goal"), F.col("cause").alias("answer")),
        "survivors": lambda: survivors(t).select(F.col("dependent").alias("goal"), F.lit("survives").alias("answer")),
    }
    return {name: make() for name, make in every.items() if only is None or name in only}


def lookup_sql() -> dict[str, str]:
    own = query.oracles
    return {
        "backup": f"SELECT part AS goal, backup AS answer FROM ({own['backup_lookup']}) WHERE part IN (SELECT node FROM ({own['resource_availability']}) WHERE state = -1)",
        "signal": f"SELECT target AS goal, signal AS answer FROM ({own['signals']}) WHERE weight > 0.4",
        "dependents": f"SELECT resource AS goal, first AS answer FROM ({own['dependents']})",
        "relation": f"SELECT a AS goal, path AS answer FROM ({own['relationship_path']})",
        "ruled_out": f"SELECT 'entity:user_' || goal AS goal, failure AS answer FROM ({own['ruled_out']})",
        "contrast": f"SELECT dependent AS goal, suppliers || ' of ' || parts AS answer FROM ({own['dependency_contrast']})",
        "condition": f"SELECT resource AS goal, first || ' to ' || last AS answer FROM ({own['condition_contrast']})",
        "predicate": f"SELECT subject AS goal, split_part(lines, '; ', 1) AS answer FROM ({own['predicate_explanation']})",
        "structured": f"SELECT 'entity:user_' || goal AS goal, chain AS answer FROM ({own['structured_chain']})",
        "forward": f"SELECT start AS goal, arg_max(node, (score, node)) AS answer FROM ({own['forward_best_path']}) GROUP BY 1",
        "ancestry": f"SELECT target AS goal, cause AS answer FROM ({own['rule_ancestry']})",
        "survivors": f"SELECT dependent AS goal, 'survives' AS answer FROM ({own['survivors']})",
    }


#: the branches of a question for a cause by priority, each with the cue that it needs
CAUSE_BRANCHES = [("backup", "backup"), ("signal", "signal"), ("dependents", "dependents"), ("relation", "relation"), ("ruled_out", "ruled_out"), ("contrast", "contrast"), ("condition", "condition"), (None, "predicate"), (None, "structured"), (None, "forward"), (None, "ancestry")]


@query("cause_dispatch", branches_sql(GOALS_SQL, [(cue, lookup_sql()[name]) for cue, name in CAUSE_BRANCHES]))
def cause_dispatch(t: Tables):
    """Eleven branches by priority: seven speak to their cue only, then predicates, structured chain, forward chain, ancestry."""
    asked = goals(t)
    found = lookups(t, asked)
    return dia.dispatch(asked, [(cue, found[name]) for cue, name in CAUSE_BRANCHES])


def relation_branches_sql() -> list[tuple[str | None, str]]:
    own, asked = lookup_sql(), answer_queries.ORACLES
    order = "'entity:order_' || goal_id"
    return [
        ("signal", own["signal"]), ("survivors", own["survivors"]), ("dependents", own["dependents"]), ("relation", own["relation"]),
        (None, f"SELECT 'entity:part_' || goal_id AS goal, answer FROM ({asked['best_answer']})"),
        (None, f"SELECT {order} AS goal, answer FROM ({asked['direct_relation']})"),
        (None, f"SELECT 'entity:event_' || goal_id AS goal, answer FROM ({asked['direct_rule']})"),
        (None, with_views("places") + " SELECT s AS goal, o AS answer FROM places"),
        (None, "SELECT goal, 'Unknown' AS answer FROM goals"),
    ]


PLACED_SQL = GOALS_SQL + " UNION ALL SELECT 'entity:customer_' || c_custkey, 'why' FROM customer"


@query("relation_dispatch", branches_sql(PLACED_SQL, relation_branches_sql()))
def relation_dispatch(t: Tables):
    """Signals, survivors, dependency list, relationship, ranked answers, direct facts, direct rules, places, Unknown."""
    asked = goals(t).unionByName(t.customer.select(facts.symbol("customer", F.col("c_custkey")).alias("goal"), F.lit("why").alias("cue")))
    cued = ("signal", "survivors", "dependents", "relation")
    found = lookups(t, asked, cued)
    named = lambda kind, df: df.select(facts.symbol(kind, F.col("goal_id")).alias("goal"), "answer")
    plain = [
        named("part", answer_queries.best_answer(t)), named("order", answer_queries.direct_relation(t)), named("event", answer_queries.direct_rule(t)),
        facts.places(t).select(F.col("s").alias("goal"), F.col("o").alias("answer")), asked.select("goal", F.lit("Unknown").alias("answer")),
    ]
    return dia.dispatch(asked, [(n, found[n]) for n in cued] + [(None, df) for df in plain])


@query(
    "chain_choice",
    EV.replace("WITH ", "WITH RECURSIVE ", 1) + f""", walk AS (SELECT id AS target, event_id AS k, id AS chain, 1 AS n FROM ev WHERE event_type = 'purchase' UNION ALL SELECT target, ev.event_id, chain || ' | ' || id, n + 1 FROM walk JOIN ev ON nxt = k WHERE n < 9),
  e AS (SELECT target, max(n) AS n, arg_max(chain, n) AS chain FROM walk GROUP BY 1), s AS ({ROLE_LIST}), r AS (SELECT DISTINCT goal FROM ({query.oracles['ruled_out']}))
SELECT target, CASE WHEN s.n >= e.n THEN 'structured' ELSE 'explanation' END AS chosen, CASE WHEN s.n >= e.n THEN s.chain ELSE e.chain END || CASE WHEN r.goal IS NULL THEN ' | outcome ' || target ELSE '' END AS chain
FROM e JOIN ev ON id = target JOIN s ON s.goal = user_id LEFT JOIN r ON r.goal = user_id AND user_id % 2 = 0""",
)
def chain_choice(t: Tables):
    """Per purchase the richer of its user's structured chain and of what came before it; the outcome, unless the user asks what is ruled out (see `goals`) and something is."""
    causes = facts.event_order(t).select(F.col("s").alias("cause"), F.col("o").alias("effect"), F.col("conf").alias("score"))
    targets = t.events.filter("event_type = 'purchase'").select(facts.event_symbol(F.col("event_id")).alias("target"), F.col("user_id").alias("goal"))
    explained = paths.explanation(causes, targets.select("target"), depth=8).select("target", F.split("chain", " < ").alias("lines"))
    structured = targets.join(structured_chain(t), "goal").select("target", F.split("chain", r" \| ").alias("lines"))
    return dia.richer_chain(structured, explained, targets.filter("goal % 2 = 0").join(ruled_out(t), "goal", "left_semi"))


QUERIES, ORACLES = query.queries, query.oracles
