"""How well a candidate fits its goal: entity, relation and type match, for relation and place goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

#: What is given where nothing speaks for or against: entity, relation, type; and what a mismatch gives. Fixed values.
ENTITY, RELATION, TYPE, MISFIT, OTHER_RANGE = 0.8, 0.7, 0.8, 0.2, 0.6


def closed(pairs: DataFrame, low: str, high: str) -> DataFrame:
    """(low, high) of a closure with every term under itself."""
    terms = pairs.select(F.explode(F.array(low, high)).alias(low)).distinct()
    return pairs.select(low, high).unionByName(terms.withColumn(high, F.col(low))).distinct()


def fitting(rows: DataFrame, thing: str, wanted: str, types: DataFrame, subclass: DataFrame, name: str) -> DataFrame:
    """Adds `name`: 1.0 if a type of `thing` is `wanted` or below it, 0.2 if none is, 0.8 if nothing is wanted or the thing is unknown."""
    asked = rows.select(thing, wanted).filter(f"{thing} IS NOT NULL AND trim({wanted}) <> ''").distinct()
    # Types that no class axiom names are under themselves only.
    wider = types.select(F.col("id").alias(thing), "type").join(subclass.select(F.col("child").alias("type"), F.col("parent").alias("up")), "type", "left")
    ups = wider.select(thing, F.explode(F.array_compact(F.array("type", "up"))).alias(wanted)).distinct().withColumn("fits", F.lit(True))
    known = types.select(F.col("id").alias(thing)).distinct().withColumn("known", F.lit(True))
    found = asked.join(known, thing).join(ups, [thing, wanted], "left").select(thing, wanted, F.when(F.col("fits"), 1.0).otherwise(MISFIT).alias(name))
    return rows.join(found, [thing, wanted], "left").withColumn(name, F.coalesce(name, F.lit(TYPE)))


def rewrites(goals: DataFrame, subproperty: DataFrame, inverse: DataFrame) -> DataFrame:
    """(predicate, p): predicates of facts that say what a goal's IRI predicate says: below it, its inverse, or below that."""
    asked = goals.select("predicate").filter(exprs.is_iri(F.col("predicate"))).distinct()
    turned = inverse.select("p", "q").unionByName(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    back = asked.join(turned.withColumnRenamed("p", "predicate"), "predicate").select("predicate", F.col("q").alias("top"))
    tops = asked.select("predicate", F.col("predicate").alias("top")).unionByName(back)
    below = tops.join(subproperty.select(F.col("parent").alias("top"), F.col("child").alias("p")), "top").select("predicate", "p")
    return below.unionByName(back.select("predicate", F.col("top").alias("p"))).distinct()


def is_place(p: Column) -> Column:
    return F.coalesce(p.isin(exprs.LOCATION_FAMILY), F.lit(False))


def match_scores(candidates: DataFrame, goals: DataFrame, types: DataFrame, subclass: DataFrame, subproperty: DataFrame, inverse: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds entity_match, relation_match, type_match and their product, match, to (goal_id, answer, s, p, o: the evidence).

    goals (goal_id, gtype, subject, object, predicate, expected_type, entity_type, expected_range); types (id, type); closures
    subclass and subproperty (child, parent); inverse (p, q); ranges (p, range). Relation goals ask whether the evidence has their
    subject or object, their predicate or a rewrite of it, and the answer their type. Place goals (gtype WHERE) ask for the type
    of what is placed, for a predicate that places or has the expected range, and for that range.
    """
    sub, sub_p = closed(subclass, "child", "parent"), subproperty.select("child", "parent").distinct()
    rows = candidates.select("goal_id", "answer", "s", "p", "o").join(goals, "goal_id")
    rows = fitting(rows, "answer", "expected_type", types, sub, "answer_fit")
    rows = fitting(rows.withColumn("placed", F.coalesce("s", "subject")), "placed", "entity_type", types, sub, "placed_fit")
    said = rewrites(goals, sub_p, inverse).withColumn("rewritten", F.lit(True))
    rows = rows.join(said, ["predicate", "p"], "left")
    wider = ranges.select("p", F.col("range").alias("child")).join(sub, "child", "left").select("p", F.explode(F.array_compact(F.array("child", "parent"))).alias("expected_range")).distinct()
    rows = rows.join(wider.withColumn("in_range", F.lit(True)), ["p", "expected_range"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    where = F.col("gtype") == "WHERE"
    p, wants = F.col("p"), F.trim(F.coalesce("expected_range", F.lit(""))) != ""
    same_end = yes(F.col("subject") == F.col("s")) | yes(F.col("object") == F.col("o"))
    same_p = yes(p == F.col("predicate")) | yes(F.col("rewritten"))
    entity = F.when(where, F.col("placed_fit")).otherwise(F.when(same_end, 1.0).otherwise(ENTITY))
    by_range = F.when(is_place(p), 1.0).when(wants & yes(exprs.is_iri(p)), F.when(yes(F.col("in_range")), 1.0).otherwise(OTHER_RANGE)).otherwise(RELATION)
    relation = F.when(where, by_range).otherwise(F.when(same_p, 1.0).otherwise(RELATION))
    place_type = F.when(~wants, TYPE).when(is_place(p) | yes(exprs.is_iri(p)) & yes(F.col("in_range")), 1.0).otherwise(MISFIT)
    kind = F.when(where, place_type).otherwise(F.col("answer_fit"))
    scored = rows.select("goal_id", "answer", "s", "p", "o", "gtype", entity.alias("entity_match"), relation.alias("relation_match"), kind.alias("type_match"))
    return scored.withColumn("match", exprs.clamp(F.col("entity_match") * F.col("relation_match") * F.col("type_match")))
