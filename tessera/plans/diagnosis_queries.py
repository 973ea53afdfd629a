"""Diagnostic answers over sessions of events; SQL pairs each signal with each failure and looks at every fact for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import answers
from ..operators.ontology import closure, cut
from ..sources import facts
from ..sources.facts import Tables, with_views
from .register import Register

query = Register()

SUFFIXES = ["_loss", "_main_unit", "_system", "", ""]
MODIFIERS = ["the sequence", "recovery chain", None, "by evidence"]
#: events of a user that make one session
SESSION = 6

SESSIONS = f"""b AS (SELECT event_id AS k, user_id, event_type AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
    'entity:' || event_type || list_extract({SUFFIXES}, event_id % 5 + 1) || '_' || event_id AS id FROM events),
  e AS (SELECT *, user_id * 1000 + rn // {SESSION} AS goal, rn // {SESSION} AS no FROM b), n AS (SELECT *, lead(id) OVER (PARTITION BY goal ORDER BY rn) AS nx FROM e),
  f AS (SELECT goal, id AS s, list_extract(['during', 'after', 'before', 'before'], k % 4 + 1) AS p, nx AS o, k * 10 AS seq FROM n WHERE nx IS NOT NULL AND k % 3 > 0
    UNION ALL SELECT goal, id, 'fail', 'concept:true', k * 10 + 1 FROM n WHERE t = 'error' UNION ALL SELECT goal, id, 'operate', 'concept:false', k * 10 + 2 FROM n WHERE t = 'click' AND value < 10
    UNION ALL SELECT goal, id, 'control', 'concept:false', k * 10 + 3 FROM n WHERE t = 'view' AND value < 30 UNION ALL SELECT goal, id, 'cause', nx, k * 10 + 4 FROM n WHERE t = 'error' AND nx IS NOT NULL
    UNION ALL SELECT goal, id, 'restore', nx, k * 10 + 5 FROM n WHERE t = 'view' AND nx IS NOT NULL),
  rl AS (SELECT goal, id AS s, 'warn' AS p, 'concept:true' AS o, nx AS cs, CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'control' END AS cp, CASE WHEN k % 2 = 0 THEN 'concept:true' ELSE 'concept:false' END AS co FROM n WHERE t = 'signup' AND nx IS NOT NULL),
  tg AS (SELECT goal, CASE WHEN any_value(no) % 5 = 0 THEN arg_min(id, rn) ELSE coalesce(arg_min(id, rn) FILTER (WHERE t = 'purchase'), arg_min(id, rn)) END AS target, list_extract(['the sequence', 'recovery chain', NULL, 'by evidence'], any_value(no) % 4 + 1) AS modifier FROM n GROUP BY 1),
  spec AS (SELECT goal, id AS node, t, k % 5 = 0 AS loss, CASE k % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 1.2 WHEN 2 THEN 0.8 ELSE 1.1 END AS sp, replace(substr(id, 8), '_', ' ') AS name, t = 'purchase' AND k % 2 = 0 AS controlled FROM n),
  pre AS (SELECT DISTINCT goal, s AS node FROM f JOIN tg USING (goal) WHERE p IN ('before', 'cause') AND o = target), evi AS (SELECT goal, node FROM pre UNION SELECT goal, s FROM f JOIN tg USING (goal) WHERE p IN ('before', 'cause') AND s = target),
  com AS (SELECT DISTINCT goal, s AS node FROM f WHERE p = 'fail' OR p = 'operate'), sub AS (SELECT goal, node FROM com UNION SELECT goal, cs FROM rl WHERE cp = 'fail'), los AS (SELECT goal, s AS node FROM f WHERE p = 'control' UNION SELECT goal, cs FROM rl WHERE cp = 'control'),
  rec AS (SELECT f.* FROM f JOIN spec ON spec.goal = f.goal AND node = o WHERE p IN ('during', 'after') AND t = 'signup'), age AS (SELECT DISTINCT rec.goal, s AS node FROM rec JOIN spec ON spec.goal = rec.goal AND node = s WHERE t NOT IN ('click', 'view')),
  tf AS (FROM f WHERE p IN ('before', 'after', 'during')), tim AS (SELECT goal, s AS node FROM tf UNION SELECT goal, o FROM tf)"""


def support(sources: str, nodes: str) -> str:
    return f"""SELECT x.goal, y.node, sum(CASE WHEN s = x.node AND o = y.node THEN 0.4 WHEN p = 'after' AND s = y.node AND o = x.node THEN 0.4 WHEN p = 'before' AND s = y.node AND o = x.node THEN 0.2 WHEN p = 'during' AND (s = x.node OR s = y.node) THEN 0.2 ELSE 0 END) AS w
    FROM {sources} x JOIN {nodes} y ON x.goal = y.goal JOIN tf ON tf.goal = x.goal GROUP BY ALL"""


ALIGNED = f"""tn AS (SELECT goal, target AS node FROM tg), pf AS ({support("pre", "sub")}), ef AS ({support("evi", "sub")}), pt AS ({support("pre", "tn")}), et AS ({support("evi", "tn")}),
  al AS (SELECT goal, sub.node, sp, loss, tim.node IS NOT NULL AS timed, round((0.6 * coalesce(pf.w, 0) + 0.4 * coalesce(pt.w, 0) + 0.4 * coalesce(ef.w, 0) + 0.2 * coalesce(et.w, 0) + CASE WHEN modifier = 'the sequence' THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score
    FROM sub JOIN tg USING (goal) JOIN spec USING (goal, node) LEFT JOIN pf USING (goal, node) LEFT JOIN ef USING (goal, node) LEFT JOIN pt USING (goal) LEFT JOIN et USING (goal) LEFT JOIN tim USING (goal, node)),
  fs AS (SELECT al.goal, al.node, al.loss, al.sp, round((al.score + 0.3 * al.sp + CASE WHEN al.timed THEN 0.4 ELSE 0 END + CASE WHEN t2.node IS NOT NULL THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS total FROM al JOIN tg ON tg.goal = al.goal LEFT JOIN tim t2 ON t2.goal = al.goal AND t2.node = target),
  fit AS (SELECT goal, coalesce(arg_min(node, (-total, node)) FILTER (WHERE NOT loss), arg_min(node, (-sp, node))) AS node, max(total) FILTER (WHERE NOT loss) AS score FROM fs GROUP BY 1)"""


def sessions(t: Tables) -> dict[str, DataFrame]:
    """Six events of a user are a session, which is one goal: its facts, rules, target, roles of its nodes, candidates."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (k % 5).cast("int"))
    each = t.events.withColumn("rn", F.row_number().over(own) - 1).withColumn("id", F.concat(F.lit("entity:"), "event_type", suffix, F.lit("_"), k.cast("string")))
    each = each.withColumn("no", F.floor(F.col("rn") / SESSION)).withColumn("goal", F.col("user_id") * 1000 + F.col("no"))
    each = cut(each.withColumn("nx", F.lead("id").over(Window.partitionBy("goal").orderBy("rn"))).select("goal", "no", "rn", "event_id", "event_type", "value", "id", "nx"))
    kind, follows = F.col("event_type"), F.col("nx").isNotNull()
    when = F.get(F.array(*map(F.lit, ["during", "after", "before", "before"])), (k % 4).cast("int"))
    row = lambda test, p, o, at: each.filter(test).select("goal", F.col("id").alias("s"), p.alias("p"), o.alias("o"), (k * 10 + at).alias("seq"))
    true, false = F.lit("concept:true"), F.lit("concept:false")
    told = facts.union(
        row(follows & (k % 3 > 0), when, F.col("nx"), 0), row(kind == "error", F.lit("fail"), true, 1), row((kind == "click") & (F.col("value") < 10), F.lit("operate"), false, 2),
        row((kind == "view") & (F.col("value") < 30), F.lit("control"), false, 3), row((kind == "error") & follows, F.lit("cause"), F.col("nx"), 4), row((kind == "view") & follows, F.lit("restore"), F.col("nx"), 5),
    )
    even = k % 2 == 0
    side = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
    ruled = each.filter((kind == "signup") & follows).select("goal", side(F.col("id"), F.lit("warn"), true).alias("ant"), side(F.col("nx"), F.when(even, "fail").otherwise("control"), F.when(even, true).otherwise(false)).alias("con"))
    first = F.min_by("id", "rn")
    bought = F.min_by("id", F.when(kind == "purchase", F.col("rn")))
    modifier = F.get(F.array(*map(F.lit, MODIFIERS)), (F.min("no") % 4).cast("int"))
    targets = each.groupBy("goal").agg(F.when(F.min("no") % 5 == 0, first).otherwise(F.coalesce(bought, first)).alias("target"), modifier.alias("modifier"))
    role = F.when(kind == "error", "failure").when(kind == "click", "evidence_signal").when(kind == "purchase", F.when(even, "outcome; control_target").otherwise("outcome")).when(kind == "signup", "recovery_phase").otherwise("temporal_marker")
    roles = each.select("id", role.alias("role"))
    weights = t.spark.createDataFrame([("before", 0.25), ("cause", 0.5)], "p string, weight double")
    told, targets = cut(told), cut(targets)
    found = cut(answers.candidates(told, ruled, targets, roles, weights))
    return {"facts": told, "rules": ruled, "targets": targets, "roles": roles, "weights": weights, "found": found, "events": each}


KINDS = " UNION ALL ".join(f"SELECT goal, '{kind}' AS kind, node FROM {cte}" for kind, cte in (("component", "com"), ("subsystem", "sub"), ("loss", "los"), ("precursor", "pre"), ("evidence", "evi"), ("agent", "age")))


@query("explanation_candidates", f"WITH {SESSIONS} {KINDS}")
def explanation_candidates(t: Tables):
    return sessions(t)["found"]


OUTCOMES = """prim AS (SELECT f.goal, arg_min(o, (-sp, o)) AS node FROM f JOIN spec ON spec.goal = f.goal AND node = o WHERE p = 'cause' AND t = 'purchase' GROUP BY 1),
  oc AS (SELECT tg.goal, target, modifier, CASE WHEN t = 'purchase' THEN target WHEN t IN ('click', 'view') OR loss OR modifier IN ('recovery chain', 'by evidence') THEN coalesce(prim.node, target) ELSE target END AS outcome FROM tg JOIN spec ON spec.goal = tg.goal AND spec.node = target LEFT JOIN prim ON prim.goal = tg.goal)"""


@query("outcome_targets", f"WITH {SESSIONS}, {OUTCOMES} SELECT goal, target, outcome FROM oc")
def outcome_targets(t: Tables):
    """The most specific outcome takes the place of signals, markers, losses, and of other targets where a chain is asked for."""
    s = sessions(t)
    return answers.outcome_targets(s["targets"], answers.primary_outcomes(s["facts"], s["roles"]), s["roles"])


@query("session_alignment", f"WITH {SESSIONS}, {ALIGNED} SELECT goal, node, score FROM al")
def session_alignment(t: Tables):
    s = sessions(t)
    return answers.alignment(answers.of_kind(s["found"], answers.COMPONENT, answers.SUBSYSTEM), s["found"], s["targets"], s["facts"])


@query("aligned_failure", f"WITH {SESSIONS}, {ALIGNED} SELECT goal, node, score FROM fit")
def aligned_failure(t: Tables):
    s = sessions(t)
    return answers.aligned_failure(s["found"], s["targets"], s["facts"])


@query("causes_ruled_out", f"WITH {SESSIONS}, {ALIGNED} SELECT goal, node, score FROM (SELECT *, max(greatest(score, CASE WHEN timed THEN 0.4 ELSE 0 END)) OVER (PARTITION BY goal) AS best FROM al WHERE NOT loss) WHERE best < 0.3 AND score < 0.2 QUALIFY row_number() OVER (PARTITION BY goal ORDER BY node) <= 3")
def causes_ruled_out(t: Tables):
    s = sessions(t)
    return answers.ruled_out(s["found"], s["targets"], s["facts"])


RESTORED = """agent AS (SELECT goal, arg_min(node, (tier, -sp, node)) AS node, min(tier) AS tier FROM (SELECT goal, node, 0 AS tier FROM age UNION ALL SELECT f.goal, s, 1 FROM f JOIN oc ON oc.goal = f.goal AND outcome = o WHERE p = 'restore') JOIN spec USING (goal, node) GROUP BY 1)"""


@query("restored_by", f"WITH {SESSIONS}, {OUTCOMES}, {RESTORED} SELECT goal, node, tier FROM agent")
def restored_by(t: Tables):
    """Who was active during or after the recovery, else who restored the outcome."""
    s = sessions(t)
    outcomes = answers.outcome_targets(s["targets"], answers.primary_outcomes(s["facts"], s["roles"]), s["roles"])
    return answers.restorers(s["found"], outcomes, s["facts"])


@query(
    "signal_answer",
    f"""WITH {SESSIONS}, said AS (SELECT goal, arg_min(node, (-sp, node)) AS node FROM spec WHERE t = 'click' AND goal % 2 = 0 GROUP BY 1), gr AS (SELECT f.goal, s AS node, max(CASE p WHEN 'cause' THEN 0.5 ELSE 0.25 END) AS w FROM f WHERE p IN ('before', 'cause') GROUP BY ALL),
  best AS (SELECT goal, arg_min(node, (-round((w + sp)::DOUBLE, 6), node)) AS node FROM gr JOIN spec USING (goal, node) GROUP BY 1)
SELECT goal, coalesce(said.node, best.node) AS node, CASE WHEN said.node IS NULL THEN 1 ELSE 0 END AS tier FROM tg LEFT JOIN said USING (goal) LEFT JOIN best USING (goal) WHERE coalesce(said.node, best.node) IS NOT NULL""",
)
def signal_answer(t: Tables):
    """Every second session's text names its events; the others' signals come from the weighted facts."""
    s = sessions(t)
    names = F.array_join(F.transform(F.array_sort(F.collect_list("id")), exprs.display), ", ")
    texts = s["events"].groupBy("goal").agg(F.when(F.col("goal") % 2 == 0, F.concat(F.lit("Seen: "), names)).otherwise("Which signal was it?").alias("text"))
    return answers.signal_answers(texts, s["found"], s["facts"], s["roles"], s["weights"])


CHAIN = f"""cc AS (SELECT goal, com.node, row_number() OVER (PARTITION BY goal ORDER BY loss, -sp, com.node) AS place FROM com JOIN spec USING (goal, node) QUALIFY place <= 2), sb AS (SELECT sub.goal, sub.node, sp, loss FROM sub JOIN spec USING (goal, node) JOIN tg ON tg.goal = sub.goal WHERE sub.node <> target),
  fc AS (SELECT fit.goal, fit.node, com.node IS NOT NULL AS is_com FROM fit LEFT JOIN com USING (goal, node)), foc AS (SELECT goal, coalesce(max(node) FILTER (WHERE is_com), max(bestc), max(node)) AS node FROM (SELECT fc.*, cc.node AS bestc FROM fc LEFT JOIN cc ON cc.goal = fc.goal AND place = 1) GROUP BY 1),
  oth AS (SELECT sb.goal, arg_min(sb.node, (loss, -sp, sb.node)) AS node FROM sb JOIN fc ON fc.goal = sb.goal AND is_com JOIN foc ON foc.goal = sb.goal WHERE sb.node <> foc.node GROUP BY 1),
  thi AS (SELECT goal, node FROM (SELECT goal, node FROM fc WHERE NOT is_com UNION ALL FROM oth) WHERE goal IN (SELECT goal FROM cc) AND (goal, node) NOT IN (SELECT (goal, node) FROM cc)),
  fai AS (SELECT goal, node, place FROM cc UNION ALL SELECT goal, node, 3 FROM thi UNION ALL SELECT goal, node, row_number() OVER (PARTITION BY goal ORDER BY loss, -sp, node) AS place FROM sb WHERE goal NOT IN (SELECT goal FROM com) QUALIFY place <= 2),
  nm AS (SELECT goal, node, name, controlled, sp, loss FROM spec), bl AS (SELECT goal, arg_min(node, (-sp, node)) AS node FROM los JOIN spec USING (goal, node) GROUP BY 1), bp AS (SELECT goal, arg_min(node, (loss, -sp, node)) AS node FROM pre JOIN spec USING (goal, node) GROUP BY 1),
  ln AS (SELECT goal, 0 AS pos, 'Precursor signal was ' || name || '.' AS line FROM bp JOIN nm USING (goal, node) UNION ALL SELECT goal, place, CASE place WHEN 1 THEN 'The ' || name || ' failed.' ELSE 'This caused the ' || name || ' to fail.' END FROM fai JOIN nm USING (goal, node)
    UNION ALL SELECT goal, 4, 'The ' || name || ' does not control.' FROM bl JOIN nm USING (goal, node) UNION ALL SELECT oc.goal, 5, 'Outcome: ' || CASE WHEN controlled THEN 'loss of ' ELSE '' END || name || '.' FROM oc JOIN nm ON nm.goal = oc.goal AND node = outcome
    UNION ALL SELECT goal, 6, 'Recovery: ' || name || ' was active during recovery.' FROM agent JOIN nm USING (goal, node) JOIN oc USING (goal) WHERE modifier = 'recovery chain'),
  tot AS (SELECT goal, count(*) AS n FROM ln GROUP BY 1), ev6 AS (SELECT evi.goal, node, row_number() OVER (PARTITION BY evi.goal ORDER BY node) AS place FROM evi),
  fin AS (FROM ln UNION ALL SELECT goal, 7, 'Evidence: ' || name || '.' FROM ev6 JOIN tot USING (goal) JOIN nm USING (goal, node) WHERE place <= 6 - n
    UNION ALL SELECT DISTINCT f.goal, 8, 'The ' || a.name || ' ' || p || ' ' || z.name || '.' FROM f JOIN foc ON foc.goal = f.goal JOIN oc ON oc.goal = f.goal JOIN nm a ON a.goal = f.goal AND a.node = s JOIN nm z ON z.goal = f.goal AND z.node = o WHERE p IN ('before', 'after') AND (s = foc.node AND o = outcome OR s = outcome AND o = foc.node))"""


@query("structured_answer", f"WITH {SESSIONS}, {ALIGNED}, {OUTCOMES}, {RESTORED}, {CHAIN} SELECT goal, string_agg(line, ' | ' ORDER BY pos, line) AS chain FROM fin GROUP BY 1")
def structured_answer(t: Tables):
    s = sessions(t)
    got = answers.structured_chains(s["found"], s["targets"], s["facts"], s["roles"])
    return got.select("goal", F.array_join("lines", " | ").alias("chain"))


def asked_suppliers(t: Tables) -> DataFrame:
    """Each supplier's least part is what it is asked about: the part itself, or for every second supplier the part's type, or for every fifth all of them."""
    least = t.lineitem.groupBy("l_suppkey").agg(F.min("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_type"), "p_partkey")
    part, kind = facts.symbol("part", F.col("p_partkey")), facts.concept(F.col("p_type"))
    symbol = F.when(F.col("l_suppkey") % 5 == 0, "concept:product").when(F.col("l_suppkey") % 2 == 0, kind).otherwise(part)
    return least.select(F.col("l_suppkey").alias("goal"), F.lit(0).alias("place"), symbol.alias("symbol"))


@query(
    "dependency_answer",
    f"""{with_views("pairs")}, {SESSIONS}, a AS (SELECT l_suppkey AS goal, 'entity:part_' || p_partkey AS part, 'concept:' || replace(lower(p_type), ' ', '_') AS kind FROM (SELECT l_suppkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1) JOIN part USING (p_partkey)),
  m AS (SELECT goal, CASE WHEN goal % 5 = 0 THEN 'concept:product' WHEN goal % 2 = 0 THEN kind ELSE part END AS symbol FROM a), kinds AS (SELECT 'entity:part_' || p_partkey AS s, 'concept:' || replace(lower(p_type), ' ', '_') AS kind FROM part),
  cov AS (SELECT DISTINCT symbol, s FROM (SELECT DISTINCT symbol FROM m) JOIN kinds ON symbol = kind OR symbol = s OR symbol = 'concept:product'),
  fl AS (SELECT symbol, replace('The ' || substr(s, 8) || ' poweredby ' || substr(o, 8) || '.', '_', ' ') AS line, seq FROM pairs JOIN cov USING (s) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq, line) <= 4),
  rv AS (SELECT goal // 1000 AS goal, replace('The ' || substr(s, 8) || ' ' || p || ' ' || substr(o, 8) || '.', '_', ' ') AS line, seq FROM rec QUALIFY row_number() OVER (PARTITION BY goal // 1000 ORDER BY seq) <= 2),
  x AS (SELECT goal, 0 AS kind, line, seq FROM rv WHERE goal IN (SELECT goal FROM m) UNION ALL SELECT goal, 1, line, seq FROM m JOIN fl USING (symbol)),
  y AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY kind, seq) AS place, max(kind) OVER (PARTITION BY goal) > min(kind) OVER (PARTITION BY goal) AS mixed FROM x)
SELECT goal, string_agg(line, ' | ' ORDER BY kind, seq) || CASE WHEN bool_or(mixed) THEN ' | This suggests the recovery likely did not depend on ' || replace(regexp_replace(any_value(symbol), '^(entity|concept):', ''), '_', ' ') || '.' ELSE '' END AS answer FROM y JOIN m USING (goal) WHERE place <= 4 GROUP BY goal""",
)
def dependency_answer(t: Tables):
    """A supplier's question about a part, a type of parts, or all products; its recovery facts are those of the user with its number."""
    s = sessions(t)
    recovered = s["facts"].withColumn("goal", F.floor(F.col("goal") / 1000))
    above = closure(facts.subclass(t), "child", "parent")
    got = answers.dependency_contrasts(asked_suppliers(t), facts.part_powered_by(t), facts.entity_types(t), above, recovered, s["roles"])
    return got.select("goal", F.array_join("lines", " | ").alias("answer"))


IF = "'If ' || replace(substr({0}, 8), '_', ' ') || ' is unavailable but ' || replace(substr({1}, 8), '_', ' ') || ' remains available, then ' || replace(substr({2}, 8), '_', ' ') || ' may fail while ' || replace(substr({3}, 8), '_', ' ') || ' can operate.'"


@query(
    "condition_answer",
    f"""{with_views("requires")}, o2 AS (SELECT o_orderkey AS goal, 'entity:order_' || o_orderkey AS a, 'entity:order_' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_orderkey % 2 = 0 AS by_order FROM orders), fst AS (SELECT s, arg_min(o, (seq, o)) AS o FROM requires GROUP BY 1),
  r AS (SELECT s AS a, o AS resource, substr(o, 13)::BIGINT AS place, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS status FROM requires JOIN part ON o = 'entity:part_' || p_partkey),
  g AS (SELECT goal, count(*) AS n, arg_min(resource, place) FILTER (WHERE status < 0) AS down, arg_min(resource, place) FILTER (WHERE status > 0) AS up, list(resource ORDER BY place) AS l FROM r JOIN o2 USING (a) WHERE NOT by_order OR b IS NULL GROUP BY 1),
  sd AS (SELECT goal, CASE WHEN down IS NOT NULL AND up IS NOT NULL THEN down ELSE l[1] END AS gone, CASE WHEN down IS NOT NULL AND up IS NOT NULL THEN up ELSE l[2] END AS kept FROM g WHERE n > 1), bw AS (SELECT o AS kept, min(s) AS works FROM requires GROUP BY 1)
SELECT goal, {IF.format("x.o", "y.o", "a", "b")} AS answer, 'mention' AS way FROM o2 JOIN fst x ON x.s = a JOIN fst y ON y.s = b WHERE by_order
UNION ALL SELECT goal, {IF.format("gone", "kept", "arg_min(s, (seq, s))", "works")}, 'resource' FROM sd JOIN bw USING (kept) JOIN requires ON o = gone WHERE s <> works GROUP BY goal, gone, kept, works""",
)
def condition_answer(t: Tables):
    """Every second order is compared with its customer's next one; the others name the parts that they require, of which some are gone."""
    me = facts.symbol("order", F.col("o_orderkey"))
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = t.orders.select(F.col("o_orderkey").alias("goal"), me.alias("a"), facts.symbol("order", after).alias("b"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    asked = pairs.filter("even").select("goal", F.posexplode(F.array("a", "b")).alias("place", "symbol")).filter("symbol IS NOT NULL")
    requires = facts.order_requires(t)
    status = F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, -1).otherwise(0)
    states = t.part.select(facts.symbol("part", F.col("p_partkey")).alias("resource"), F.col("p_partkey").alias("place"), status.alias("status"))
    resources = requires.select(F.col("s").alias("a"), F.col("o").alias("resource")).join(states, "resource").join(pairs.filter("NOT even OR b IS NULL").select("goal", "a"), "a").select("goal", "place", "resource", "status")
    return answers.condition_contrasts(asked, resources, requires)


@query(
    "predicate_answer",
    f"""WITH {SESSIONS}, q AS (SELECT k AS goal, list_extract(['before', 'fail', 'restore'], k % 3 + 1) AS p, CASE WHEN k % 2 = 0 THEN id END AS s, CASE WHEN k % 2 = 1 THEN id END AS o FROM n),
  sps AS (SELECT node, sp, name FROM spec UNION ALL VALUES ('concept:true', 0.55, 'true'), ('concept:false', 0.55, 'false')),
  ft AS (SELECT s, p, o, 0 AS tier, 'The ' || a.name || CASE WHEN o = 'concept:true' THEN ' ' || p WHEN o = 'concept:false' THEN ' does not ' || p ELSE ' ' || p || ' ' || z.name END || '.' AS line, round(-(a.sp + z.sp + CASE p WHEN 'before' THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS less FROM f JOIN sps a ON a.node = s JOIN sps z ON z.node = o
    UNION ALL SELECT cs, cp, co, 1, 'If the ' || a.name || ' warn, then the ' || z.name || CASE cp WHEN 'fail' THEN ' fail' ELSE ' does not control' END || '.', round(-(z.sp + 0.55)::DOUBLE, 6) FROM rl JOIN sps a ON a.node = s JOIN sps z ON z.node = cs),
  own AS (SELECT goal, tier, less, line FROM q JOIN ft ON q.p = ft.p AND (q.s = ft.s OR q.o = ft.o)),
  rs AS (SELECT e.k AS goal, 2 AS tier, rec.seq::DOUBLE AS less, 'The ' || a.name || ' ' || p || ' ' || z.name || '.' AS line FROM e JOIN rec ON rec.goal = e.goal JOIN sps a ON a.node = s JOIN sps z ON z.node = o WHERE e.k % 3 = 2),
  u AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY tier, less, line) AS place FROM (FROM own UNION ALL FROM rs))
SELECT goal, string_agg(line, ' | ' ORDER BY place) AS answer FROM u WHERE place <= 3 GROUP BY 1""",
)
def predicate_answer(t: Tables):
    """What is said of an event with `before`, `fail` or `restore`: facts, then rules, then the session's recovery."""
    s = sessions(t)
    k = F.col("event_id")
    predicate = F.get(F.array(F.lit("before"), F.lit("fail"), F.lit("restore")), (k % 3).cast("int"))
    goals = s["events"].select(k.alias("goal"), predicate.alias("predicate"), F.when(k % 2 == 0, F.col("id")).alias("subject"), F.when(k % 2 == 1, F.col("id")).alias("object"))
    of_session = s["events"].select("goal", k.alias("key")).filter("key % 3 = 2")
    recovered = s["facts"].join(of_session, "goal").drop("goal").withColumnRenamed("key", "goal")
    dynamic = t.spark.createDataFrame([("before", 0.1)], "p string, weight double")
    got = answers.predicate_lines(goals, s["facts"], s["rules"], recovered, s["roles"], dynamic)
    return got.select("goal", F.array_join("lines", " | ").alias("answer"))


QUERIES, ORACLES = query.queries, query.oracles
