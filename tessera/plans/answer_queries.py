"""Queries that answer tables of goals, score and rank the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import query as ask
from ..operators import scoring
from ..sources import facts
from ..sources.facts import SQL, Tables, with_views
from .register import Register

query = Register()

NULL = lambda name: F.lit(None).cast("string").alias(name)


def axioms(t: Tables):
    """Predicate axioms of the tables' graph: `with` is symmetric, `in`/`contains` are inverse, `locatedIn` is below `in`."""
    table = t.spark.createDataFrame
    predicates = table([(p,) for p in ("with", "in", "contains", "requires", "poweredBy", "seenAs")], "p string")
    flags = table([("with", True, False)], "p string, symmetric boolean, transitive boolean")
    inverse = table([("in", "contains")], "p string, inv string")
    subprop = table([("locatedIn", "in")], "child string, parent string")
    aliases = table([("seenAs", "with")], "p string, alias string")
    return ask.rewrites(predicates, flags, inverse, subprop, aliases)


def goal(df, key, subject, predicate, obj, expected=None):
    return df.select(key.cast("long").alias("goal_id"), (NULL("subject") if subject is None else subject.alias("subject")), F.lit(predicate).alias("predicate"), (NULL("object") if obj is None else obj.alias("object")), (NULL("expected_type") if expected is None else expected.alias("expected_type")))


def part_goals(t: Tables):
    """Which suppliers is part P with?"""
    return goal(t.part, F.col("p_partkey"), facts.symbol("part", F.col("p_partkey")), "with", None, F.lit("concept:supplier"))


def compatible(t: Tables):
    """(type, wider): each type with itself and everything above it (three levels here)."""
    sub = facts.subclass(t)
    up = sub.select(F.col("child").alias("type"), F.col("parent").alias("wider"))
    two = up.join(sub, F.col("wider") == F.col("child")).select("type", F.col("parent").alias("wider"))
    own = facts.entity_types(t).select("type", F.col("type").alias("wider")).distinct()
    return own.union(up).union(two).distinct()


def scored(t: Tables, goals, relation: float = 1.0):
    """Typed, scored, softmaxed and ranked answers of the goals."""
    found = ask.relation_query(goals, facts.part_with_supplier(t), axioms(t))
    fit = ask.typed(found, goals, facts.entity_types(t), compatible(t))
    head = exprs.mean_score(F.col("qmatch"), F.when(F.coalesce("type_fit", F.lit(True)), 1.0).otherwise(0.5), F.col("conf"), F.lit(ask.NEUTRAL_FOCUS))
    match = scoring.query_match(F.lit("RELATION"), F.lit(1.0), F.lit(relation), scoring.type_score(F.col("type_fit")))
    both = fit.withColumn("head_score", F.round(head, 9)).withColumn("score", F.round(exprs.clamp(head * match), 9))
    return scoring.rank(scoring.softmax(both))


SCORED = (
    SQL["pairs"]
    + """, head AS (SELECT CAST(substr(s, 13) AS BIGINT) AS goal_id, s, o AS answer, seq, conf, round(least(1.0, (1.0 + 1.0 + conf + 0.6) / 4), 9) AS head_score FROM pairs),
  cand AS (SELECT *, round(head_score, 9) AS score FROM head),
  soft AS (SELECT *, exp(score - max(score) OVER (PARTITION BY goal_id)) AS e FROM cand),
  ranked AS (SELECT *, e / sum(e) OVER (PARTITION BY goal_id) AS prob, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, answer) AS rank FROM soft)"""
)


@query("rel_query_subject", f"WITH {SCORED} SELECT goal_id, answer, round(score, 6) AS score, round(prob, 6) AS prob, rank, s || ' with ' || answer AS evidence FROM ranked")
def rel_query_subject(t: Tables):
    got = scored(t, part_goals(t))
    return got.select("goal_id", "answer", F.round("score", 6).alias("score"), F.round("prob", 6).alias("prob"), "rank", F.concat_ws(" ", "s", "p", "o").alias("evidence"))


@query(
    "rel_query_object",
    with_views("pairs") + " SELECT CAST(substr(o, 17) AS BIGINT) AS goal_id, s AS answer, round(least(1, (1 + 1 + conf + 0.6) / 4), 6) AS head_score FROM pairs",
)
def rel_query_object(t: Tables):
    """Which parts are with supplier S?"""
    goals = goal(t.supplier, F.col("s_suppkey"), None, "with", facts.symbol("supplier", F.col("s_suppkey")))
    got = ask.relation_query(goals, facts.part_with_supplier(t), axioms(t)).filter("qmatch = 1.0")
    return got.select("goal_id", "answer", F.round(exprs.mean_score(F.col("qmatch"), F.lit(1.0), F.col("conf"), F.lit(0.6)), 6).alias("head_score"))


@query("rel_symmetric", with_views("pairs") + " SELECT CAST(substr(o, 17) AS BIGINT) AS goal_id, s AS answer, 1.0::DOUBLE AS qmatch, round(least(1, (1.0 + 1 + conf + 0.6) / 4), 6) AS head_score FROM pairs")
def rel_symmetric(t: Tables):
    """Supplier S is with what? The facts say it the other way round."""
    goals = goal(t.supplier, F.col("s_suppkey"), facts.symbol("supplier", F.col("s_suppkey")), "with", None)
    got = ask.relation_query(goals, facts.part_with_supplier(t), axioms(t))
    return got.select("goal_id", "answer", "qmatch", F.round(exprs.mean_score(F.col("qmatch"), F.lit(1.0), F.col("conf"), F.lit(0.6)), 6).alias("head_score"))


@query("symmetric_fallback", with_views("pairs") + " SELECT CAST(substr(s, 13) AS BIGINT) AS goal_id, o AS answer, 0.85::DOUBLE AS qmatch FROM pairs")
def symmetric_fallback(t: Tables):
    """? poweredBy part P: no fact has the part as object; were the predicate symmetric, the part's own facts answer."""
    own = facts.part_powered_by(t)
    goals = goal(t.part, F.col("p_partkey"), None, "poweredBy", facts.symbol("part", F.col("p_partkey")))
    symmetric = t.spark.createDataFrame([("poweredBy",)], "p string")
    return ask.symmetric_fallback(goals, ask.relation_query(goals, own, axioms(t)), own, symmetric).select("goal_id", "answer", "qmatch")


@query("rel_inverse", with_views("places") + " SELECT o AS place, s AS answer, 0.9::DOUBLE AS qmatch FROM places")
def rel_inverse(t: Tables):
    """Place P contains what? `contains` is the inverse of `in`, and `locatedIn` is below `in`."""
    nations = t.nation.select(F.col("n_nationkey").alias("k"), facts.named(F.col("n_name")).alias("place"))
    regions = t.region.select((F.col("r_regionkey") + 1000).alias("k"), facts.named(F.col("r_name")).alias("place"))
    both = nations.union(regions)
    got = ask.relation_query(goal(both, F.col("k"), F.col("place"), "contains", None), facts.places(t), axioms(t))
    return got.select(F.col("o").alias("place"), "answer", "qmatch")


@query("rel_predicate_only", with_views("places") + " SELECT s AS answer, o, round(least(1, (1 + 0.5 + conf + 0.6) / 4), 6) AS head_score FROM places WHERE p = 'in'")
def rel_predicate_only(t: Tables):
    goals = goal(t.spark.range(1), F.col("id"), None, "in", None)
    got = ask.open_query(goals, facts.places(t))
    return got.select("answer", "o", F.round(exprs.mean_score(F.col("qmatch"), F.lit(0.5), F.col("conf"), F.lit(0.6)), 6).alias("head_score"))


@query("predicate_alias", with_views("pairs") + " SELECT CAST(substr(s, 13) AS BIGINT) AS goal_id, count(*) AS n FROM pairs GROUP BY 1")
def predicate_alias(t: Tables):
    """`seenAs` is an alias of `with`."""
    goals = goal(t.part, F.col("p_partkey"), facts.symbol("part", F.col("p_partkey")), "seenAs", None)
    return ask.relation_query(goals, facts.part_with_supplier(t), axioms(t)).groupBy("goal_id").agg(F.count("*").alias("n"))


@query(
    "yes_no",
    """SELECT c_custkey AS goal_id, CASE WHEN c_nationkey = c_custkey % 25 THEN 'Yes, entity:customer_' || c_custkey || ' locatedIn entity:nation_' || (c_custkey % 25) ELSE 'Unknown.' END AS answer,
  CASE WHEN c_nationkey = c_custkey % 25 THEN 0.95::DOUBLE END AS score FROM customer""",
)
def yes_no(t: Tables):
    """Is customer C in nation C mod 25?"""
    goals = t.customer.select(F.col("c_custkey").alias("goal_id"), facts.symbol("customer", F.col("c_custkey")).alias("subject"), F.lit("locatedIn").alias("predicate"), facts.symbol("nation", F.col("c_custkey") % 25).alias("object"))
    direct = t.spark.createDataFrame([("locatedIn", "locatedIn", False, 1.0)], "p string, p2 string, swap boolean, qmatch double")
    return ask.yes_no(goals, facts.places(t), direct).withColumn("score", F.round("score", 6))


@query("count_query", "SELECT p_partkey AS goal_id, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def count_query(t: Tables):
    """How many suppliers had returns of part P? None is an answer, 0."""
    returned = t.lineitem.filter("l_returnflag = 'R'").select(facts.symbol("part", F.col("l_partkey")).alias("s"), F.lit("with").alias("p"), facts.symbol("supplier", F.col("l_suppkey")).alias("o"), F.lit(0.9).alias("conf"), F.col("l_orderkey").alias("seq"))
    goals = part_goals(t)
    return ask.count_query(goals, ask.relation_query(goals, returned, axioms(t)))


@query("attribute_query", with_views("attributes") + " SELECT s AS subject, substr(o, 9) AS answer, round((conf + 0.6) / 2, 6) AS head_score FROM attributes")
def attribute_query(t: Tables):
    parts = t.part.select(facts.symbol("part", F.col("p_partkey")).alias("subject"))
    people = t.customer.select(facts.symbol("customer", F.col("c_custkey")).alias("subject"))
    goals = parts.union(people).withColumn("goal_id", F.col("subject"))
    return ask.attribute_query(goals, facts.attributes(t), ["hasAttribute", "attributeRelation"]).select(F.col("goal_id").alias("subject"), "answer", F.round("head_score", 6).alias("head_score"))


@query(
    "modifier_filter",
    """SELECT l_suppkey AS goal_id, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_suppkey % 2 = 1 OR lower(replace(p_brand, ' ', '_')) = 'brand#11' GROUP BY 1""",
)
def modifier_filter(t: Tables):
    """Even suppliers are asked for parts of one brand, odd ones for "other" parts, which is no modifier."""
    goals = t.supplier.select(F.col("s_suppkey").alias("goal_id"), NULL("subject"), F.lit("with").alias("predicate"), facts.symbol("supplier", F.col("s_suppkey")).alias("object"), F.when(F.col("s_suppkey") % 2 == 0, "brand#11").otherwise("other").alias("modifier"))
    found = ask.relation_query(goals, facts.part_with_supplier(t), axioms(t)).filter("qmatch = 1.0")
    return ask.with_modifier(found, goals, facts.attributes(t)).groupBy("goal_id").agg(F.count_distinct("answer").alias("n"))


@query(
    "expected_type",
    """SELECT l_suppkey AS goal_id, count(DISTINCT l_partkey) AS answers, count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_partkey WHEN l_suppkey % 3 = 1 AND lower(p_type) = (SELECT min(lower(p_type)) FROM part) THEN l_partkey END) AS fitting
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def expected_type(t: Tables):
    """Suppliers are asked for products, for one type, or for people."""
    least = t.part.select(facts.concept(F.col("p_type")).alias("expected")).agg(F.min("expected").alias("expected"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, F.lit("concept:product")).when(F.col("s_suppkey") % 3 == 1, F.col("expected")).otherwise("concept:person")
    goals = goal(t.supplier.crossJoin(F.broadcast(least)), F.col("s_suppkey"), None, "with", facts.symbol("supplier", F.col("s_suppkey")), kind)
    found = ask.typed(ask.relation_query(goals, facts.part_with_supplier(t), axioms(t)).filter("qmatch = 1.0"), goals, facts.entity_types(t), compatible(t))
    return found.groupBy("goal_id").agg(F.count_distinct("answer").alias("answers"), F.count_distinct(F.when(F.col("type_fit"), F.col("answer"))).alias("fitting"))


@query(
    "person_preference",
    """WITH c AS (SELECT c_nationkey::BIGINT AS goal_id, 'entity:customer_' || c_custkey AS answer, 1 AS tier FROM customer UNION ALL SELECT s_nationkey, 'entity:supplier_' || s_suppkey, 3 FROM supplier),
  m AS (SELECT *, min(tier) OVER (PARTITION BY goal_id) AS best FROM c) SELECT goal_id, answer FROM m WHERE tier = best""",
)
def person_preference(t: Tables):
    """Who is in nation N? People first; only where there are none, others."""
    from pyspark.sql import Window

    goals = goal(t.nation, F.col("n_nationkey"), None, "in", facts.named(F.col("n_name")), F.lit("concept:person"))
    fit = ask.typed(ask.relation_query(goals, facts.places(t), axioms(t)), goals, facts.entity_types(t), compatible(t))
    tier = F.when(F.col("type_fit"), 1).when(F.col("answer").rlike("person|people|man|woman|boy|girl"), 2).otherwise(3)
    best = F.min("tier").over(Window.partitionBy("goal_id"))
    return fit.filter("qmatch = 1.0").withColumn("tier", tier).withColumn("best", best).filter("tier = best").select("goal_id", "answer")


@query(
    "goal_gate",
    """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CASE event_type WHEN 'view' THEN value > 50 WHEN 'click' THEN value > 30 WHEN 'error' THEN TRUE WHEN 'purchase' THEN value > 20 ELSE FALSE END) AS valid FROM events GROUP BY 1""",
)
def goal_gate(t: Tables):
    """Events as goals of five kinds, some without the parts their kind needs."""
    kind = F.when(F.col("event_type") == "view", "WHERE").when(F.col("event_type") == "click", "RELATION").when(F.col("event_type") == "error", "ATTRIBUTE").when(F.col("event_type") == "purchase", "YESNO").otherwise("OTHER")
    sym = facts.event_symbol(F.col("event_id"))
    goals = t.events.select(
        "event_type", kind.alias("gtype"), sym.alias("subject"), F.when(F.col("value") > 20, sym).alias("object"), F.when(F.col("value") > 30, F.lit("before")).when(F.col("event_type") == "purchase", F.lit("before")).alias("predicate"),
        F.when(F.col("value") > 50, F.lit("concept:event")).alias("entity_type"), F.lit("level").alias("attribute"),
    )
    checked = ask.valid_goals(goals)
    return checked.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("checked") != "UNKNOWN", 1)).alias("valid"))


@query("range_alignment", with_views("places") + " SELECT s AS subject, o AS answer, round((0.9 + 1 + 1.0 + conf) / 4, 6) AS head_score FROM places WHERE s LIKE 'entity:customer%'")
def range_alignment(t: Tables):
    """Where are people? Facts whose predicate's range is a place or below, whose subject fits the type."""
    ranges = t.spark.createDataFrame([("locatedIn", "concept:nation"), ("in", "concept:region")], "p string, range string")
    wide = compatible(t)
    placed = ranges.join(wide, F.col("range") == F.col("type")).filter("wider = 'concept:place'").select("p").distinct()
    who = facts.entity_types(t).join(wide, "type").filter("wider = 'concept:person'").select(F.col("id").alias("s")).distinct()
    got = facts.places(t).join(placed, "p", "left_semi").join(who, "s", "left_semi")
    return got.select(F.col("s").alias("subject"), F.col("o").alias("answer"), F.round(exprs.mean_score(F.lit(0.9), F.lit(1.0), F.lit(1.0), F.col("conf")), 6).alias("head_score"))


@query(
    "colocation_transfer",
    with_views("places", "pairs") + " SELECT x.s AS subject, l.o AS location, round(max((x.conf + l.conf) / 2), 6) AS conf FROM pairs x JOIN places l ON x.o = l.s GROUP BY 1, 2",
)
def colocation_transfer(t: Tables):
    """A part is where a supplier it is with is."""
    own = facts.union(facts.places(t), facts.part_with_supplier(t))
    return ask.colocation_transfer(own, ["with", "near"], exprs.LOCATION_FAMILY).withColumn("conf", F.round("conf", 6))


@query(
    "location_chain",
    with_views("places")
    + """ SELECT a.s AS subject, coalesce(b.p, a.p) AS predicate, coalesce(b.o, a.o) AS terminal, CASE WHEN b.s IS NULL THEN 1 ELSE 2 END AS hops,
  round(least(1, CASE WHEN b.s IS NULL THEN a.conf ELSE (a.conf + b.conf) / 2 + 0.05 END), 6) AS conf FROM places a LEFT JOIN places b ON a.o = b.s""",
)
def location_chain(t: Tables):
    return ask.location_chain(facts.places(t), exprs.LOCATION_FAMILY).withColumn("conf", F.round("conf", 6))


@query(
    "subgoal_expansion",
    with_views("pairs", "types")
    + """, g AS (SELECT row_number() OVER (ORDER BY type) AS goal_id, type FROM (SELECT DISTINCT type FROM types WHERE id LIKE 'entity:part%'))
SELECT goal_id, o AS target, 'concept:supplier' AS target_type, 1 AS depth, round((max(conf) + 0.6) / 2, 6) AS score FROM g JOIN types USING (type) JOIN pairs ON s = id GROUP BY 1, 2""",
)
def subgoal_expansion(t: Tables):
    """Where is a part of type T? Ask where its suppliers are."""
    from pyspark.sql import Window

    kinds = t.part.select(facts.concept(F.col("p_type")).alias("entity_type")).distinct()
    goals = kinds.withColumn("goal_id", F.row_number().over(Window.orderBy("entity_type")).cast("long")).withColumn("depth", F.lit(0))  # a row per type
    return ask.subgoals(goals, facts.entity_types(t), facts.part_with_supplier(t), ["with"]).withColumn("score", F.round("score", 6))


@query(
    "goal_resolution",
    with_views("pairs", "places") + " SELECT DISTINCT x.s AS goal_id, l.o AS place, 1 AS hops FROM pairs x JOIN places l ON x.o = l.s UNION ALL SELECT s, o, 0 FROM places WHERE s LIKE 'entity:customer%'",
)
def goal_resolution(t: Tables):
    """Where is each part and customer? Customers have a place; parts have none, so their suppliers are asked."""
    goals = t.part.select(facts.symbol("part", F.col("p_partkey")).alias("goal_id")).union(t.customer.select(facts.symbol("customer", F.col("c_custkey"))))
    own = facts.union(facts.places(t), facts.part_with_supplier(t))
    return ask.resolve(goals.withColumn("subject", F.col("goal_id")), own, ["with"], exprs.LOCATION_FAMILY)


@query("direct_rule", with_views("ev") + " SELECT event_id AS goal_id, 'concept:true' AS answer FROM ev WHERE nxt IS NOT NULL OR event_id IN (SELECT nxt FROM ev)")
def direct_rule(t: Tables):
    """Does event E fail? Asked of the rules' two sides."""
    from ..operators import diagnose
    from .rule_queries import ground_rules

    goals = goal(t.events, F.col("event_id"), facts.event_symbol(F.col("event_id")), "fail", None)
    return ask.direct_rule(goals, diagnose.rule_sides(ground_rules(t)))


@query("direct_relation", with_views("requires") + " SELECT CAST(substr(s, 14) AS BIGINT) AS goal_id, o AS answer FROM requires")
def direct_relation(t: Tables):
    goals = goal(t.orders, F.col("o_orderkey"), facts.symbol("order", F.col("o_orderkey")), "http://example.org/onto#Requires", None)
    return ask.direct_relation(goals, facts.order_requires(t)).select("goal_id", "answer")


@query("direct_where", with_views("places") + " SELECT o AS place, arg_min(s, (seq, s)) AS first FROM places WHERE p = 'locatedIn' GROUP BY 1")
def direct_where(t: Tables):
    """The first subject placed in each place."""
    own = facts.places(t).filter(F.col("p") == "locatedIn")
    return own.groupBy(F.col("o").alias("place")).agg(F.min_by("s", F.struct("seq", "s")).alias("first"))


@query("temporal_match", with_views("ev") + " SELECT event_id AS goal_id, 'entity:event_' || nxt AS answer FROM ev WHERE nxt IS NOT NULL AND event_type = 'error'")
def temporal_match(t: Tables):
    """What came after each error?"""
    errors = t.events.filter("event_type = 'error'")
    goals = goal(errors, F.col("event_id"), facts.event_symbol(F.col("event_id")), "before", None)
    return ask.direct_relation(goals, facts.event_order(t)).select("goal_id", "answer")


@query(
    "temporal_bridge",
    """WITH d AS (SELECT DISTINCT event_type AS s, user_id AS o FROM events) SELECT a.s AS a, b.s AS b, count(*) AS n FROM d a JOIN d b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2""",
)
def temporal_bridge(t: Tables):
    """Event types bridged by a user in whose time they fall."""
    during = t.events.select(F.col("event_type").alias("s"), F.lit("during").alias("p"), F.col("user_id").cast("string").alias("o"))
    kinds = t.events.select("event_type").distinct()  # five
    asked = kinds.select(F.col("event_type").alias("a")).join(kinds.select(F.col("event_type").alias("b")), F.col("a") < F.col("b"))
    return ask.temporal_bridge(during, asked).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "predicate_between",
    "SELECT 'entity:part_' || l_partkey AS a, 'entity:supplier_' || l_suppkey AS b, 'with' AS p FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
)
def predicate_between(t: Tables):
    """Between part and supplier stand `with` and, inserted later, `poweredBy`."""
    later = facts.part_powered_by(t).withColumn("seq", F.col("seq") + 10**13)
    pairs = facts.part_with_supplier(t).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return ask.predicate_between(pairs, facts.union(facts.part_with_supplier(t), later))


@query(
    "mention_pair_facts",
    with_views("requires", "pairs") + " SELECT priority, p, count(*) AS n FROM (SELECT p, 10 AS priority FROM requires UNION ALL SELECT p, 2 FROM pairs) GROUP BY 1, 2",
)
def mention_pair_facts(t: Tables):
    """Facts between mentioned things by the priority of their predicate."""
    own = facts.union(facts.order_requires(t), facts.part_with_supplier(t))
    return own.select("p", ask.predicate_priority(F.col("p")).alias("priority")).groupBy("priority", "p").agg(F.count("*").alias("n"))


@query("attention_score", f"WITH {SCORED} SELECT goal_id, round(avg(score) + 1e-9, 6) AS mean_score, round(max(prob), 6) AS top_prob FROM ranked GROUP BY 1")
def attention_score(t: Tables):
    return scored(t, part_goals(t)).groupBy("goal_id").agg(F.round(F.avg("score") + 1e-9, 6).alias("mean_score"), F.round(F.max("prob"), 6).alias("top_prob"))


@query("softmax_rank", f"WITH {SCORED} SELECT goal_id, round(sum(prob), 6) AS total, count(*) AS n, max(rank) AS last FROM ranked GROUP BY 1")
def softmax_rank(t: Tables):
    return scored(t, part_goals(t)).groupBy("goal_id").agg(F.round(F.sum("prob"), 6).alias("total"), F.count("*").alias("n"), F.max("rank").alias("last"))


KINDS_SQL = """k AS (SELECT user_id AS goal_id, CAST(event_id AS VARCHAR) AS answer, round(value / 1000, 9) AS score,
  CASE event_type WHEN 'purchase' THEN 'ANSWER' WHEN 'error' THEN 'QUERY_PLAN' WHEN 'signup' THEN 'SUBGOAL' ELSE 'ASSERTION' END AS ctype FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, answer) AS rank FROM k),
  l AS (SELECT *, first_value(ctype) OVER (PARTITION BY goal_id ORDER BY rank) AS leader FROM r)"""


def kinds(t: Tables):
    """Each user's events as candidates of four kinds."""
    kind = F.when(F.col("event_type") == "purchase", "ANSWER").when(F.col("event_type") == "error", "QUERY_PLAN").when(F.col("event_type") == "signup", "SUBGOAL").otherwise("ASSERTION")
    return scoring.rank(t.events.select(F.col("user_id").alias("goal_id"), F.col("event_id").cast("string").alias("answer"), F.round(F.col("value") / 1000, 9).alias("score"), kind.alias("ctype")))


@query(
    "winner_preference",
    f"WITH {KINDS_SQL} SELECT goal_id, answer, ctype FROM (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY CASE WHEN ctype = 'ANSWER' THEN 0 WHEN ctype = 'QUERY_PLAN' THEN 1 WHEN ctype = 'ASSERTION' AND leader = 'SUBGOAL' THEN 2 ELSE 3 END, rank) AS n FROM l) WHERE n = 1",
)
def winner_preference(t: Tables):
    """Each user's events as candidates of four kinds; answers come first."""
    return scoring.winner(kinds(t)).select("goal_id", "answer", "ctype")


@query("statement_winner", f"WITH {KINDS_SQL} SELECT goal_id, answer, ctype FROM (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY CASE WHEN ctype = 'ASSERTION' THEN 0 ELSE 1 END, rank) AS n FROM l) WHERE n = 1")
def statement_winner(t: Tables):
    return scoring.statement_winner(kinds(t)).select("goal_id", "answer", "ctype")


@query("best_answer", f"WITH {SCORED} SELECT goal_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY round(prob + 0.05 * 1.1, 9) DESC, rank) AS n FROM ranked) WHERE n = 1")
def best_answer(t: Tables):
    return scoring.best_answer(scored(t, part_goals(t))).select("goal_id", "answer")


@query("candidate_kinds", f"WITH {KINDS_SQL} SELECT ctype, count(*) AS n FROM r WHERE ctype IN ('ANSWER', 'SUBGOAL', 'QUERY_PLAN', 'CLARIFICATION') GROUP BY 1")
def candidate_kinds(t: Tables):
    """Questions keep answers, subgoals, plans and clarifications."""
    return kinds(t).filter(F.col("ctype").isin("ANSWER", "SUBGOAL", "QUERY_PLAN", "CLARIFICATION")).groupBy("ctype").agg(F.count("*").alias("n"))


@query("trace_top_k", f"WITH {SCORED} SELECT goal_id, answer, rank, rank = 1 AS is_winner FROM ranked WHERE rank <= 3")
def trace_top_k(t: Tables):
    from ..operators import store

    return store.trace(scored(t, part_goals(t)), 3).select("goal_id", "answer", "rank", "is_winner")


@query(
    "echo_filter",
    """WITH c AS (SELECT a.user_id AS goal_id, 'entity:' || a.event_type AS subject, 'entity:' || b.event_type AS answer FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b USING (user_id)
  WHERE a.event_type = (SELECT min(event_type) FROM events)),
  m AS (SELECT *, max(answer <> subject) OVER (PARTITION BY goal_id) AS others FROM c) SELECT goal_id, answer FROM m WHERE answer <> subject OR NOT others""",
)
def echo_filter(t: Tables):
    """A user's event types besides the goal's own; that one only where there is no other."""
    own = t.events.select("user_id", "event_type").distinct()
    least = t.events.agg(F.min("event_type").alias("least"))
    goals = own.join(F.broadcast(least), F.col("event_type") == F.col("least")).select(F.col("user_id").alias("goal_id"), F.concat(F.lit("entity:"), "event_type").alias("subject"), NULL("object"))
    answers = own.join(goals, F.col("user_id") == F.col("goal_id")).select("goal_id", F.concat(F.lit("entity:"), "event_type").alias("answer"))
    return ask.echo_free(answers, goals).select("goal_id", "answer")


@query(
    "discourse_exclusion",
    """SELECT DISTINCT l_partkey AS key, l_suppkey AS answer FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_partkey = l.l_partkey AND h.l_suppkey = l.l_suppkey AND h.l_returnflag = 'R')""",
)
def discourse_exclusion(t: Tables):
    """Who else? Suppliers of a part other than those already named (with returns)."""
    own = t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("answer"), "l_returnflag")
    return ask.unseen(own.select("key", "answer").distinct(), own.filter("l_returnflag = 'R'"))


@query("multi_answer", with_views("pairs") + " SELECT CAST(substr(s, 13) AS BIGINT) AS goal_id, string_agg(o, ', ' ORDER BY o) AS text, count(*) AS n FROM pairs GROUP BY 1")
def multi_answer(t: Tables):
    goals = part_goals(t)
    return scoring.multi_answer(ask.relation_query(goals, facts.part_with_supplier(t), axioms(t)))


@query("evidence_list", f"WITH {SCORED} SELECT goal_id, string_agg(s || ' with ' || answer, '; ' ORDER BY rank) AS evidence FROM ranked WHERE rank <= 3 GROUP BY 1")
def evidence_list(t: Tables):
    got = scored(t, part_goals(t)).select("goal_id", "rank", F.concat_ws(" ", "s", "p", "o").alias("evidence"))
    return scoring.evidence(got)


@query("answer_facts", f"WITH {SCORED} SELECT 'answer' AS s, 'names' AS p, answer AS o, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL")
def answer_facts(t: Tables):
    """A triple-shaped answer of a subgoal becomes a fact."""
    won = scored(t, part_goals(t)).filter("rank = 1").select(exprs.triple_text(F.concat_ws(" ", F.lit("answer names"), "answer")).alias("f"))
    return won.filter("f IS NOT NULL").groupBy("f.s", "f.p", "f.o").agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
