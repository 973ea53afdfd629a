"""First places by type, answers in time, predicates between entities with rules, ontology labels, faulty annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import lookups
from ..operators.ontology import closure
from ..sources import facts
from ..sources.facts import Tables, with_views
from .register import Register

query = Register()


@query(
    "where_by_type",
    with_views("places") + """, g AS (SELECT o_orderkey AS goal_id, CASE o_orderkey % 5 WHEN 0 THEN 'concept:person' WHEN 1 THEN 'Supplier' WHEN 2 THEN 'concept:place' WHEN 3 THEN 'customer_' || o_custkey END AS kind FROM orders),
  k AS (SELECT *, CASE WHEN s LIKE 'entity:customer%' THEN 'concept:person' WHEN s LIKE 'entity:supplier%' THEN 'Supplier' ELSE 'concept:place' END AS kind FROM places),
  b AS (SELECT kind, arg_min(s || ' ' || lower(p) || ' ' || o, (seq, s)) AS answer FROM k GROUP BY 1 UNION ALL SELECT substr(s, 8), s || ' ' || lower(p) || ' ' || o FROM places UNION ALL SELECT '', arg_min(s || ' ' || lower(p) || ' ' || o, (seq, s)) FROM places)
SELECT goal_id, answer FROM g JOIN b ON coalesce(g.kind, '') = b.kind""",
)
def where_by_type(t: Tables):
    """Where is a person, a supplier, a place, one customer by name, or anything?"""
    key = F.col("o_orderkey")
    kind = F.when(key % 5 == 0, "concept:person").when(key % 5 == 1, "Supplier").when(key % 5 == 2, "concept:place").when(key % 5 == 3, F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")))
    goals = t.orders.select(key.alias("goal_id"), kind.alias("entity_type"))
    got = lookups.first_places(goals, facts.places(t), facts.entity_types(t), closure(facts.subclass(t), "child", "parent"), exprs.LOCATION_FAMILY)
    return got.select("goal_id", F.concat_ws(" ", "s", "p", "o").alias("answer"))


@query(
    "temporal_answers",
    with_views("ev") + """, r AS (SELECT event_id AS k, id AS s, 'entity:event_' || nxt AS o FROM ev WHERE nxt IS NOT NULL UNION ALL SELECT event_id, id, 'concept:' || event_type FROM ev WHERE event_id % 3 = 0),
  g AS (SELECT event_id AS goal_id, id, CASE event_id % 4 WHEN 3 THEN 'with' ELSE 'before' END AS p, event_id % 4 <> 2 AS by_subject FROM ev),
  a AS (SELECT DISTINCT goal_id, g.p, CASE WHEN by_subject THEN r.o ELSE r.s END AS answer FROM g JOIN r ON CASE WHEN by_subject THEN r.s ELSE r.o END = g.id),
  w AS (SELECT *, CASE WHEN answer LIKE 'concept:%' THEN 0.55 ELSE 0.75 END AS sp, row_number() OVER (PARTITION BY goal_id ORDER BY CASE WHEN answer LIKE 'concept:%' THEN 0.55 ELSE 0.75 END DESC, answer) AS n, bool_and(answer LIKE 'entity:%') OVER (PARTITION BY goal_id) AS whole FROM a)
SELECT goal_id, answer, sp::DOUBLE AS specific, n = 1 AS best FROM w WHERE n = 1 OR whole OR p = 'with'""",
)
def temporal_answers(t: Tables):
    """What was before or after an event, where some of the answers are kinds of events; a quarter of the goals ask with another predicate."""
    key, own = F.col("event_id"), facts.event_symbol(F.col("event_id"))
    kinds = facts.fact(t.events.filter("event_id % 3 = 0"), own, "before", facts.concept(F.col("event_type")), F.lit(0.9), key)
    told = facts.union(facts.event_order(t), kinds)
    told = told.unionByName(told.withColumn("p", F.lit("with")))
    side = F.when(key % 4 != 2, own)
    goals = t.events.select(key.alias("goal_id"), F.when(key % 4 == 3, "http://x.example/onto#With").otherwise("Before").alias("predicate"), side.alias("subject"), F.when(side.isNull(), own).alias("object"))
    return lookups.temporal_answers(goals, told)


@query(
    "predicates_between",
    with_views("pairs") + """, q AS (SELECT DISTINCT l_partkey, l_suppkey, l_suppkey % 3 AS m FROM lineitem) SELECT 'entity:supplier_' || l_suppkey AS a, 'entity:part_' || l_partkey AS b, CASE m WHEN 0 THEN 'with' WHEN 1 THEN 'suppliedby' END AS p, CASE m WHEN 0 THEN 'fact' WHEN 1 THEN 'rule' END AS way FROM q""",
)
def predicates_between(t: Tables):
    """A third of the suppliers stand with their parts by a fact, a third by a rule's consequent, the others not at all."""
    own = facts.part_with_supplier(t)
    number = F.regexp_extract("o", r"\d+$", 0).cast("long") % 3
    side = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rules = own.filter(number < 2).select(side(F.col("s"), "sold", F.lit("concept:true")).alias("ant"), side(F.col("s"), "http://x.example/onto#SuppliedBy", F.col("o")).alias("con"), "seq")
    return lookups.predicates_between(own.select(F.col("o").alias("a"), F.col("s").alias("b")), own.filter(number == 0), rules)


@query(
    "label_symbols",
    """WITH l AS (SELECT p_name, min(p_partkey) % 3 AS m FROM part GROUP BY 1) SELECT p_partkey AS key, 'http://b.example/thing/' || replace(p_name, ' ', '-') AS iri, CASE m WHEN 1 THEN 'entity:' ELSE 'concept:' END || replace(p_name, ' ', '_') AS symbol FROM part JOIN l USING (p_name) WHERE m > 0""",
)
def label_symbols(t: Tables):
    """A part's name leads to an IRI and on to the symbol that is known by the IRI's label: an entity, a concept, or none."""
    names = t.part.groupBy("p_name").agg((F.min("p_partkey") % 3).alias("m"))
    labels = names.select(F.concat(F.lit("http://b.example/thing/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("iri"), F.upper("p_name").alias("label"))
    token = F.replace("p_name", F.lit(" "), F.lit("_"))
    known = names.filter("m > 0").select(F.concat(F.lit("concept:"), token).alias("symbol")).unionByName(names.filter("m = 1").select(F.concat(F.lit("entity:"), token).alias("symbol")))
    return lookups.label_links(t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("phrase")), labels, known)


@query(
    "annotation_faults",
    """WITH a AS (SELECT 'http://b.example/e/' || event_id AS iri, event_type AS annotation, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN props ELSE CAST(event_id AS VARCHAR) END ELSE list_extract(['{subject} did {object}', '{object} by it', 'plain', '{cause}'], event_id % 4 + 1) END AS value,
  CASE event_type WHEN 'click' THEN 'weight' WHEN 'view' THEN 'subject_template' ELSE 'template' END AS kind FROM events)
SELECT iri, annotation, value, CASE kind WHEN 'weight' THEN 'not a number' WHEN 'subject_template' THEN 'no subject' ELSE 'no placeholder' END AS fault FROM a WHERE kind = 'weight' AND try_cast(value AS DOUBLE) IS NULL OR kind = 'subject_template' AND NOT contains(value, '{subject}') OR kind = 'template' AND value = 'plain'""",
)
def annotation_faults(t: Tables):
    """Clicks carry weights, views templates that need a subject, other events templates."""
    key, kind = F.col("event_id"), F.col("event_type")
    template = F.get(F.array(*map(F.lit, ["{subject} did {object}", "{object} by it", "plain", "{cause}"])), (key % 4).cast("int"))
    value = F.when(kind == "click", F.when(key % 2 == 0, F.col("props")).otherwise(key.cast("string"))).otherwise(template)
    given = t.events.select(F.concat(F.lit("http://b.example/e/"), key.cast("string")).alias("iri"), kind.alias("annotation"), value.alias("value"), F.when(kind == "click", "weight").when(kind == "view", "subject_template").otherwise("template").alias("kind"))
    return lookups.annotation_faults(given)


QUERIES, ORACLES = query.queries, query.oracles
