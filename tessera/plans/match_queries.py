"""Match scores of candidates whose evidence, predicates, types and ranges fit, don't fit or are unknown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match
from ..sources import facts
from ..sources.facts import Tables
from .register import Register

query = Register()

WITH, BELOW, INVERSE, BELOW_INVERSE = (f"http://x.example/{n}" for n in ("with", "closelyWith", "suppliedBy", "soldBy"))


@query(
    "match_scores",
    f"""WITH c AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem),
  e AS (SELECT *, CASE WHEN sk % 9 = 0 THEN NULL WHEN pk % 7 = 0 THEN 'entity:nobody' ELSE 'entity:part_' || pk END AS s, CASE sk % 6 WHEN 0 THEN 'with' WHEN 1 THEN '{WITH}' WHEN 2 THEN '{BELOW}' WHEN 3 THEN '{INVERSE}' WHEN 4 THEN '{BELOW_INVERSE}' ELSE 'in' END AS p,
    CASE pk % 3 WHEN 0 THEN 'with' WHEN 1 THEN '{WITH}' END AS predicate, CASE WHEN pk % 2 = 0 THEN 'RELATION' ELSE 'WHERE' END AS gtype, sk % 5 > 0 AS known,
    CASE pk % 8 WHEN 0 THEN 'concept:supplier' WHEN 2 THEN 'concept:company' WHEN 4 THEN 'concept:nation' END AS expected, CASE pk % 5 WHEN 0 THEN 'concept:part' WHEN 1 THEN 'concept:nation' END AS entity_type,
    CASE pk % 10 WHEN 1 THEN 'concept:company' WHEN 3 THEN 'concept:supplier' WHEN 5 THEN 'concept:nation' END AS wants FROM c),
  m AS (SELECT *, wants = 'concept:company' AND p IN ('{WITH}', '{BELOW}') OR wants = 'concept:supplier' AND p = '{WITH}' AS in_range, p LIKE 'http%' AS iri FROM e),
  k AS (SELECT pk, sk,
    CASE WHEN gtype = 'WHERE' THEN CASE WHEN entity_type IS NULL THEN 0.8 WHEN coalesce(s, 'entity:part_' || pk) = 'entity:nobody' THEN 0.8 WHEN entity_type = 'concept:part' THEN 1.0 ELSE 0.2 END WHEN s = 'entity:part_' || pk THEN 1.0 ELSE 0.8 END AS entity_match,
    CASE WHEN gtype = 'WHERE' THEN CASE WHEN p = 'in' THEN 1.0 WHEN wants IS NOT NULL AND iri THEN CASE WHEN in_range THEN 1.0 ELSE 0.6 END ELSE 0.7 END
      WHEN p = predicate OR predicate = '{WITH}' AND p IN ('{BELOW}', '{INVERSE}', '{BELOW_INVERSE}') THEN 1.0 ELSE 0.7 END AS relation_match,
    CASE WHEN gtype = 'WHERE' THEN CASE WHEN wants IS NULL THEN 0.8 WHEN p = 'in' OR iri AND in_range THEN 1.0 ELSE 0.2 END WHEN expected IS NULL OR NOT known THEN 0.8 WHEN expected IN ('concept:supplier', 'concept:company') THEN 1.0 ELSE 0.2 END AS type_match FROM m)
SELECT pk AS goal_id, 'entity:supplier_' || sk AS answer, entity_match::DOUBLE AS entity_match, relation_match::DOUBLE AS relation_match, type_match::DOUBLE AS type_match, round((entity_match * relation_match * type_match)::DOUBLE, 6) AS match FROM k""",
)
def match_scores(t: Tables):
    """Suppliers as answers to relation and place goals about parts; each of the three matches takes all of its values."""
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    part = facts.symbol("part", pk)
    s = F.when(sk % 9 == 0, None).when(pk % 7 == 0, "entity:nobody").otherwise(part)
    p = F.get(F.array(*map(F.lit, ["with", WITH, BELOW, INVERSE, BELOW_INVERSE, "in"])), (sk % 6).cast("int"))
    candidates = facts.pairs(t).select(pk.alias("goal_id"), facts.symbol("supplier", sk).alias("answer"), s.alias("s"), p.alias("p"), F.lit(None).cast("string").alias("o"))
    key = F.col("p_partkey")
    expected = F.when(key % 8 == 0, "concept:supplier").when(key % 8 == 2, "concept:company").when(key % 8 == 4, "concept:nation")
    wants = F.when(key % 10 == 1, "concept:company").when(key % 10 == 3, "concept:supplier").when(key % 10 == 5, "concept:nation")
    goals = t.part.select(
        key.alias("goal_id"), F.when(key % 2 == 0, "RELATION").otherwise("WHERE").alias("gtype"), facts.symbol("part", key).alias("subject"), F.lit(None).cast("string").alias("object"),
        F.when(key % 3 == 0, "with").when(key % 3 == 1, WITH).alias("predicate"), expected.alias("expected_type"), F.when(key % 5 == 0, "concept:part").when(key % 5 == 1, "concept:nation").alias("entity_type"), wants.alias("expected_range"),
    )
    types = t.part.select(facts.symbol("part", key).alias("id"), F.lit("concept:part").alias("type")).unionByName(t.supplier.filter("s_suppkey % 5 > 0").select(facts.symbol("supplier", F.col("s_suppkey")).alias("id"), F.lit("concept:supplier").alias("type")))
    table = t.spark.createDataFrame
    subclass, below = table([("concept:supplier", "concept:company")], "child string, parent string"), table([(BELOW, WITH), (BELOW_INVERSE, INVERSE)], "child string, parent string")
    got = match.match_scores(candidates, goals, types, subclass, below, table([(WITH, INVERSE)], "p string, q string"), table([(WITH, "concept:supplier"), (BELOW, "concept:company")], "p string, range string"))
    return got.select("goal_id", "answer", "entity_match", "relation_match", "type_match", F.round("match", 6).alias("match"))


QUERIES, ORACLES = query.queries, query.oracles
