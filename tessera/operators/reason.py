"""Reasoning that goes on after an answer: asserted winners, causes of effects, focus, typed answers, traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from . import linking
from .ontology import cut
from .rules import forward_chain

KEY = ["s", "p", "o"]


def assert_and_reason(facts: DataFrame, rules: DataFrame, goals: DataFrame, rounds: int = 3) -> DataFrame:
    """(goal, s, p, o, score, round): the facts asserted for each goal, one a round.

    facts (s, p, o), ground rules (ant, con, conf), goals (goal, s: what the goal is about). Of the new
    facts about a goal the best - by score, then name - is inserted and the rules run again, up to
    `rounds` times. A round runs the rules on what the last one inserted only; facts that did not win
    stay candidates.
    """
    known = cut(facts.select(*KEY).distinct())
    fresh, waiting, asserted = known, None, None
    for number in range(1, rounds + 1):
        made = forward_chain(fresh, rules)
        made = made if waiting is None else made.unionByName(waiting).groupBy(*KEY).agg(F.max("score").alias("score"))
        waiting = cut(made.join(known, KEY, "left_anti"))
        about = waiting.join(goals, "s")
        best = about.groupBy("goal").agg(F.min(F.struct((-F.col("score")).alias("less"), *KEY)).alias("x"))
        won = cut(best.select("goal", *[f"x.{c}" for c in KEY], (-F.col("x.less")).alias("score"), F.lit(number).alias("round")))
        if won.isEmpty():
            break
        asserted = won if asserted is None else asserted.unionByName(won)
        fresh = won.select(*KEY).distinct()
        known = known.unionByName(fresh)
    return asserted if asserted is not None else won


def rule_causes(rules: DataFrame) -> DataFrame:
    """(cause, effect): either end of a rule's consequent, if an entity, is an effect; the cause is the antecedent's subject if that is one, else its object."""
    side = F.when(F.col("ant.s").startswith("entity:"), F.col("ant.s")).otherwise(F.col("ant.o"))
    ends = rules.select(side.alias("cause"), F.explode(F.array("con.s", "con.o")).alias("effect"))
    return ends.filter(F.col("effect").startswith("entity:") & (F.col("cause") != F.col("effect"))).distinct()


def cause_candidates(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(cause, effect, way): `cause` facts by object, `causedBy` facts by subject, rules that conclude the effect."""
    told = facts.filter("p = 'cause'").select(F.col("s").alias("cause"), F.col("o").alias("effect"), F.lit("cause").alias("way"))
    turned = facts.filter("p = 'causedBy'").select(F.col("o").alias("cause"), F.col("s").alias("effect"), F.lit("causedBy").alias("way"))
    return told.unionByName(turned).filter("cause <> effect").distinct().unionByName(rule_causes(rules).withColumn("way", F.lit("rule")))


def with_focus(candidates: DataFrame, goals: DataFrame, active: DataFrame) -> DataFrame:
    """Adds focus: answer active 1.0, else the goal's subject 0.9, its object 0.8, else 0.6; active (id) is the working memory."""
    own = active.select(F.col("id").alias("key"), F.lit(True).alias("hit")).distinct()
    flag = lambda df, column, name: df.join(own.select(F.col("key").alias(column), F.col("hit").alias(name)), column, "left")
    sides = flag(flag(goals.select("goal_id", "subject", "object"), "subject", "s_active"), "object", "o_active").select("goal_id", "s_active", "o_active")
    return flag(candidates.join(sides, "goal_id"), "answer", "a_active").withColumn("focus", exprs.memory_focus(F.col("s_active"), F.col("o_active"), F.col("a_active"))).drop("s_active", "o_active", "a_active")


def person_like(symbol: Column) -> Column:
    return exprs.local_name(exprs.strip_namespace(symbol)).isin(exprs.PERSON_WORDS)


def passes_type(candidates: DataFrame, types: DataFrame, compatible: DataFrame) -> DataFrame:
    """Adds passes, for (answer, expected_type): whether the answer may stand for the type.

    No expectation passes, an unknown entity fails, an expectation that is no IRI passes. An entity
    without IRI types passes unless a person is expected; else one of its types must be compatible.
    types (id, type); compatible (type, wider) with every type itself.
    """
    known = types.groupBy(F.col("id").alias("answer")).agg(F.max(exprs.is_iri(F.col("type"))).alias("has_iri"))
    fits = types.join(compatible, "type").select(F.col("id").alias("answer"), F.col("wider").alias("expected_type"), F.lit(True).alias("fits")).distinct()
    own = candidates.join(known, "answer", "left").join(fits, ["answer", "expected_type"], "left")
    expected = F.col("expected_type")
    ok = (
        F.when(expected.isNull(), True).when(F.col("has_iri").isNull(), False).when(~exprs.is_iri(expected), True)
        .when(~F.col("has_iri"), ~person_like(expected)).otherwise(F.coalesce("fits", F.lit(False)))
    )
    return own.withColumn("passes", ok).drop("has_iri", "fits")


def counted_type(candidates: DataFrame, types: DataFrame, compatible: DataFrame) -> DataFrame:
    """The candidates that a count of its expected type takes.

    A person is anything with a person word as name or type; another plain type must equal the name or a
    type; an IRI goes by `passes_type`.
    """
    by_iri = passes_type(candidates, types, compatible).withColumn("name", exprs.local_name(exprs.strip_namespace(F.col("answer"))))
    bare = types.select(F.col("id").alias("answer"), exprs.local_name(exprs.strip_namespace(F.col("type"))).alias("bare")).groupBy("answer").agg(F.collect_set("bare").alias("all"))  # a few types an entity
    want = exprs.local_name(exprs.strip_namespace(F.col("expected_type")))
    person = F.col("name").isin(exprs.PERSON_WORDS) | F.arrays_overlap(F.coalesce("all", F.array().cast("array<string>")), F.array(*map(F.lit, exprs.PERSON_WORDS)))
    same = (F.col("name") == want) | F.coalesce(F.array_contains("all", want), F.lit(False))
    ok = F.when(F.col("expected_type").isNull(), True).when(exprs.is_iri(F.col("expected_type")), F.col("passes")).when(person_like(F.col("expected_type")), person).otherwise(same)
    return by_iri.join(bare, "answer", "left").filter(ok).drop("all", "name", "passes")


def fitting_side(candidates: DataFrame, types: DataFrame, compatible: DataFrame) -> DataFrame:
    """Facts that answer a goal with no side bound: the subject, or the object where only that fits the expected type."""
    sided = candidates.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("answer")), F.struct(F.lit(1).alias("side"), F.col("o").alias("answer")))).alias("x")).select(*candidates.columns, "x.*")
    fit = passes_type(sided, types, compatible)
    return fit.filter("passes").groupBy("goal_id", "s", "p", "o").agg(F.min_by("answer", "side").alias("answer"))


def property_targets(assertions: DataFrame, annotations: DataFrame) -> DataFrame:
    """(s, p, o): assertions between named individuals (IRIs), and annotations whose value is an IRI."""
    named = assertions.filter(exprs.is_iri(F.col("s")) & exprs.is_iri(F.col("o"))).select("s", "p", "o")
    return named.unionByName(annotations.filter(exprs.is_iri(F.col("value"))).select(F.col("iri").alias("s"), F.col("annotation").alias("p"), F.col("value").alias("o"))).distinct()


def annotated_with(annotations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(annotation, value, iri): reverse look-up of (annotation, value), trimmed and in lower case."""
    form = lambda df: df.withColumn("value", F.lower(F.trim("value")))
    return form(annotations).join(form(wanted.select("annotation", "value")).distinct(), ["annotation", "value"]).select("annotation", "value", "iri").distinct()


def map_terms(terms: DataFrame, dictionary: DataFrame, least: float = 0.6, vectorizer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, label, tier): the exact label (tier 0), else the nearest by vectors (1), else null (2).

    dictionary (label). Only terms without an exact label are made vectors of.
    """
    exact = terms.select("query", exprs.normal_search(F.col("query")).alias("form")).join(dictionary.select(F.col("label").alias("exact"), exprs.normal_search(F.col("label")).alias("form")), "form", "left")
    first = exact.groupBy("query").agg(F.min("exact").alias("exact"))
    make = vectorizer or linking.hashed_vectors
    near = linking.nearest_label(first.filter("exact IS NULL").select("query"), make(dictionary.select("label").distinct()), least, make)
    both = first.join(near.select("query", F.col("label").alias("near")), "query", "left")
    tier = F.when(F.col("exact").isNotNull(), 0).when(F.col("near").isNotNull(), 1).otherwise(2)
    return both.select("query", F.coalesce("exact", "near").alias("label"), tier.alias("tier"))


def map_goal(goals: DataFrame, labels: DataFrame) -> DataFrame:
    """Goals with their terms mapped: sides get `entity:` if they have no namespace, the predicate its IRI by label, else by stem.

    labels (label, iri); a type is mapped by its label alone.
    """
    by_label = labels.groupBy(exprs.normal_search(F.col("label")).alias("form")).agg(F.min("iri").alias("iri"))
    spaced = lambda c: F.when(F.col(c).rlike(r"^(entity|concept):|^https?://") | F.col(c).isNull(), F.col(c)).otherwise(F.concat(F.lit("entity:"), F.col(c)))
    look = lambda df, form, name: df.withColumn("form", form).join(by_label.withColumnRenamed("iri", name), "form", "left").drop("form")
    own = look(goals, exprs.normal_search(F.col("predicate")), "exact")
    own = look(own, exprs.verb_stem(exprs.normal_search(F.col("predicate"))), "stem")
    own = look(own, exprs.normal_search(exprs.strip_namespace(F.col("expected_type"))), "kind")
    return own.withColumns({"subject": spaced("subject"), "object": spaced("object"), "predicate": F.coalesce("exact", "stem", "predicate"), "expected_type": F.coalesce("kind", "expected_type")}).drop("exact", "stem", "kind")


def expand_short(chains: DataFrame, paths: DataFrame, most: int = 2) -> DataFrame:
    """(goal, lines, replaced, last): chains of `most` lines or fewer give way to a longer path of their goal.

    chains (goal, n), paths (goal, hops, node): of a goal's paths the longest counts, then the best score.
    """
    best = paths.groupBy("goal").agg(F.max(F.struct("hops", "score", "node")).alias("x"))
    use = (F.col("n") <= most) & F.coalesce(F.col("x.hops") > F.col("n"), F.lit(False))
    own = chains.join(best, "goal", "left")
    return own.select("goal", F.when(use, F.col("x.hops")).otherwise(F.col("n")).cast("long").alias("lines"), use.alias("replaced"), F.when(use, F.col("x.node")).alias("last"))


def write_trace(ranked: DataFrame, folder: str) -> None:
    """Append every ranked candidate to the trace table, with is_winner; breakdown is a map of the score's parts."""
    ranked.withColumn("is_winner", F.col("rank") == 1).write.mode("append").parquet(folder)


def explain(trace: DataFrame, depth: int) -> DataFrame:
    """(goal_id, answer, rank, evidence, part, value): the first `depth` candidates of every goal, a row for each part of their score."""
    return trace.filter(F.col("rank") <= depth).select("goal_id", "answer", "rank", "evidence", F.explode("breakdown").alias("part", "value"))


def append_rules(table: DataFrame, new: DataFrame) -> DataFrame:
    """The rule table (ant, con, conf, seq) with new rules; of equal antecedent and consequent the first by seq stays."""
    order = Window.partitionBy("ant", "con").orderBy("seq")
    return table.unionByName(new).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
