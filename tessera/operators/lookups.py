"""Look-ups behind the ranked answers: first places by type, answers in time, predicates of rules, labels of the ontology, faulty annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import query
from .answers import specific

# Predicates of time, by local name.
TEMPORAL = ["before", "after", "during"]
# Placeholders of a sentence template.
PLACEHOLDERS = ["{subject}", "{object}", "{cause}", "{effect}"]


def type_token(symbol: Column) -> Column:
    return exprs.normal_token(exprs.strip_namespace(symbol))


def first_places(goals: DataFrame, facts: DataFrame, types: DataFrame, above: DataFrame, family: list[str]) -> DataFrame:
    """(goal_id, s, p, o): for goals (goal_id, entity_type) the first fact that places a thing of the type.

    A thing fits by its own name, by a type of its own, or by one above that (above: child, parent, closed); a goal
    without a type takes the first place of all. Each type's first fact is one aggregate for all goals.
    """
    placed = facts.withColumn("p", exprs.local_name(F.col("p"))).filter(F.col("p").isin([f.lower() for f in family]))
    first = F.min(F.struct("seq", "s", "p", "o")).alias("x")
    asked = goals.select("goal_id", F.coalesce(type_token(F.col("entity_type")), F.lit("")).alias("kind"))
    own = types.select(F.col("id").alias("s"), F.col("type").alias("t"))
    every = own.unionByName(own.join(above.select(F.col("child").alias("t"), "parent"), "t").select("s", F.col("parent").alias("t")))
    kinds = asked.select("kind").distinct()
    fits = every.select("s", type_token(F.col("t")).alias("kind")).join(kinds, "kind", "left_semi").distinct()
    by_type = placed.join(fits, "s").groupBy("kind").agg(first)
    by_name = placed.withColumn("kind", type_token(F.col("s"))).join(kinds, "kind", "left_semi").groupBy("kind").agg(first)
    any_ = placed.agg(first).filter("x IS NOT NULL").select(F.lit("").alias("kind"), "x")
    best = by_type.unionByName(by_name).filter("kind <> ''").unionByName(any_).groupBy("kind").agg(F.min("x").alias("x"))
    return asked.join(best, "kind").select("goal_id", "x.s", "x.p", "x.o")


def temporal_answers(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal_id, answer, specific, best): answers to goals (goal_id, predicate, subject, object) without the goal's own sides.

    before, after and during give all answers if all are entities, else only the most specific one; any other
    predicate gives all. `best` marks the most specific answer of a goal, the least name of equal ones.
    """
    found = query.direct_relation(goals, facts).select("goal_id", "answer").distinct()
    own = query.echo_free(found, goals).select("goal_id", "answer", specific(F.col("answer")).alias("specific"))
    timed = goals.select("goal_id", exprs.local_name(F.col("predicate")).isin(TEMPORAL).alias("timed"))
    first = own.groupBy("goal_id").agg(F.min(F.struct((-F.col("specific")).alias("less"), "answer")).alias("x"), F.min(F.col("answer").startswith("entity:")).alias("whole"))
    both = own.join(first, "goal_id").join(timed, "goal_id").withColumn("best", F.col("x.answer") == F.col("answer"))
    return both.filter("best OR whole OR NOT timed").select("goal_id", "answer", "specific", "best")


def predicates_between(pairs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(a, b, p, way): the local name of the first fact between two entities either way, else of the first rule's consequent; null if neither."""
    told = facts.select("s", "o", "p", "seq", F.lit(0).alias("tier"))
    said = rules.select("con.s", "con.o", "con.p", "seq", F.lit(1).alias("tier"))
    rows = told.unionByName(said).withColumn("x", F.struct("tier", "seq", exprs.local_name(F.col("p")).alias("p")))
    asked = pairs.select("a", "b").distinct()
    there = asked.join(rows, (F.col("a") == F.col("s")) & (F.col("b") == F.col("o"))).select("a", "b", "x")
    back = asked.join(rows, (F.col("a") == F.col("o")) & (F.col("b") == F.col("s"))).select("a", "b", "x")
    first = there.unionByName(back).groupBy("a", "b").agg(F.min("x").alias("x"))
    way = F.when(F.col("x.tier") == 0, "fact").when(F.col("x.tier") == 1, "rule")
    return asked.join(first, ["a", "b"], "left").select("a", "b", F.col("x.p").alias("p"), way.alias("way"))


def label_links(phrases: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """(key, iri, symbol): a phrase (key, phrase) to an IRI by a label's search form, and on to the known symbol that the IRI's
    first label names by its tokens; entities before concepts. Phrases whose IRI names no known symbol are left out."""
    form = labels.select("iri", exprs.normal_search(F.col("label")).alias("form")).distinct()
    named = labels.groupBy("iri").agg(exprs.normal_token(F.min("label")).alias("token"))
    tokens = known.select("symbol", type_token(F.col("symbol")).alias("token"), F.when(F.col("symbol").startswith("entity:"), 0).otherwise(1).alias("rank"))
    first = tokens.groupBy("token").agg(F.min(F.struct("rank", "symbol")).alias("x")).select("token", "x.symbol")
    best = form.groupBy("form").agg(F.min("iri").alias("iri"))
    return phrases.select("key", exprs.normal_search(F.col("phrase")).alias("form")).join(best, "form").join(named, "iri").join(first, "token").select("key", "iri", "symbol")


def annotation_faults(annotations: DataFrame) -> DataFrame:
    """(iri, annotation, value, fault) of annotations (iri, annotation, value, kind): weights (kind `weight`) that are no
    numbers; templates that lack {subject} though they need it (`subject_template`) or have no placeholder at all (also `template`)."""
    value = F.coalesce("value", F.lit(""))
    some = F.lit(False)
    for name in PLACEHOLDERS:
        some = some | value.contains(name)
    fault = (
        F.when((F.col("kind") == "weight") & F.expr("try_cast(trim(value) AS double)").isNull(), "not a number")
        .when((F.col("kind") == "subject_template") & ~value.contains(PLACEHOLDERS[0]), "no subject")
        .when(F.col("kind").isin("template", "subject_template") & ~some, "no placeholder")
    )
    return annotations.withColumn("fault", fault).filter("fault IS NOT NULL").select("iri", "annotation", "value", "fault")
