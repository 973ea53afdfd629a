"""Diagnostic analytics over facts, rules and role annotations: failures, causes, support, dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .store import by_predicate

# Verbs whose denial is a failure, and predicates of time and dependency.
NEGATED = ["operate", "function", "work", "respond", "stop", "stop_responding"]
TEMPORAL = ["before", "after", "during"]
DEPENDENCY = ["poweredBy", "require", "requires"]


def ends(facts: DataFrame) -> DataFrame:
    """(node, other, p, conf, seq, side): every fact from both of its ends."""
    cols = ["p", "conf", "seq"]
    return facts.select(F.col("s").alias("node"), F.col("o").alias("other"), *cols, F.lit("s").alias("side")).unionByName(facts.select(F.col("o").alias("node"), F.col("s").alias("other"), *cols, F.lit("o").alias("side")))


def failures(facts: DataFrame) -> DataFrame:
    """(s): `fail true`, self-referencing fail, or one of the working verbs with false."""
    flag = exprs.boolean_concept(F.col("o"))
    bad = (F.col("p") == "fail") & (flag | (F.col("s") == F.col("o"))) | F.col("p").isin(NEGATED) & (flag == False)  # noqa: E712
    return facts.filter(bad).select("s").distinct()


def rule_sides(rules: DataFrame) -> DataFrame:
    """Ground rules as facts: consequents, and antecedents, with `side`."""
    con = rules.select("con.*", "seq", F.lit("con").alias("side"))
    return con.unionByName(rules.select("ant.*", "seq", F.lit("ant").alias("side")))


def subsystem_failures(facts: DataFrame, rules: DataFrame) -> DataFrame:
    sides = rule_sides(rules)
    return failures(facts).unionByName(failures(sides)).distinct()


def capability_losses(facts: DataFrame) -> DataFrame:
    return facts.filter((F.col("p") == "control") & (exprs.boolean_concept(F.col("o")) == False)).select("s").distinct()  # noqa: E712


def signal_weights(facts: DataFrame, weights: DataFrame) -> DataFrame:
    """(s, weight): the largest evidence weight of a subject's predicates."""
    return by_predicate(facts, weights).groupBy("s").agg(F.max("weight").alias("weight"))


def precursors(facts: DataFrame, weights: DataFrame) -> DataFrame:
    """(target, signal, weight): subjects of evidence-weighted predicates that point at a target."""
    return by_predicate(facts, weights.filter("weight > 0")).groupBy(F.col("o").alias("target"), F.col("s").alias("signal")).agg(F.max("weight").alias("weight"))


def recovery(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """(s, p, o, is_agent): temporal facts whose object is a recovery phase; agents are neither signals nor markers."""
    phase = roles.filter(exprs.role_match(F.col("role"), "recovery_phase")).select(F.col("id").alias("o")).distinct()
    neither = roles.filter(exprs.role_match(F.col("role"), "evidence_signal") | exprs.role_match(F.col("role"), "temporal_marker")).select(F.col("id").alias("s")).distinct().withColumn("no", F.lit(True))
    found = facts.filter(F.col("p").isin(TEMPORAL)).join(phase, "o", "left_semi")
    return found.join(neither, "s", "left").select("s", "p", "o", F.col("no").isNull().alias("is_agent"))


def outcomes(causes: DataFrame, roles: DataFrame) -> DataFrame:
    """(o): effects with the role outcome."""
    return causes.select("o").distinct().join(roles.filter(exprs.role_match(F.col("role"), "outcome")).select(F.col("id").alias("o")).distinct(), "o", "left_semi")


def temporal_support(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds support to (cause, effect): a cause edge 0.4; else effect after 0.4; cause-before 0.4, effect-before 0.2; during 0.2.

    Each fact counts by the first rule that fits it.
    """
    own = facts.filter(F.col("p").isin("cause", *TEMPORAL))
    kind = (
        F.when((F.col("p") == "cause") & (F.col("s") == F.col("cause")) & (F.col("o") == F.col("effect")), 0.4)
        .when((F.col("p") == "after") & (F.col("s") == F.col("effect")) & (F.col("o") == F.col("cause")), 0.4)
        .when((F.col("p") == "before") & (F.col("s") == F.col("cause")) & (F.col("o") == F.col("effect")), 0.4)
        .when((F.col("p") == "before") & (F.col("s") == F.col("effect")) & (F.col("o") == F.col("cause")), 0.2)
    )
    there = pairs.join(own, (F.col("cause") == F.col("s")) & (F.col("effect") == F.col("o"))).select("cause", "effect", "s", "p", "o")
    back = pairs.join(own, (F.col("effect") == F.col("s")) & (F.col("cause") == F.col("o"))).select("cause", "effect", "s", "p", "o")
    either = there.unionByName(back).withColumn("w", F.coalesce(kind, F.lit(0.0)))
    during = own.filter("p = 'during'").select(F.col("s").alias("node")).distinct()
    more = pairs.select("cause", "effect", F.explode(F.array("cause", "effect")).alias("node")).join(during, "node").select("cause", "effect", F.lit(0.2).alias("w"))
    total = either.select("cause", "effect", "w").unionByName(more).groupBy("cause", "effect").agg(F.sum("w").alias("support"))
    return pairs.join(total, ["cause", "effect"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def telemetry_support(facts: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, support): evidence weight times the number of facts at the node."""
    return by_predicate(ends(facts), weights).groupBy("node").agg(F.sum("weight").alias("support"))


def cause_scores(causes: DataFrame, facts: DataFrame, evidence: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(cause, effect, p, score): specificity + temporal support + telemetry support + dynamic weight."""
    pairs = causes.select(F.col("s").alias("cause"), F.col("o").alias("effect"), "p").distinct()
    timed = temporal_support(pairs.select("cause", "effect").distinct(), facts)
    told = telemetry_support(facts, evidence).select(F.col("node").alias("cause"), F.col("support").alias("telemetry"))
    all_ = by_predicate(pairs.join(timed, ["cause", "effect"]).join(told, "cause", "left"), dynamic, "left")
    score = exprs.specificity(F.col("cause")) + F.col("support") + F.coalesce("telemetry", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0))
    return all_.select("cause", "effect", "p", score.alias("score"))


def evidence_alignment(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(goal, failure, score): 0.6 / 0.4 of the signals' support for failure / outcome, 0.4 / 0.2 of the nodes'.

    signals and nodes: (goal, failure, to_failure, to_outcome).
    """
    part = lambda df, a, b: df.select("goal", "failure", (a * F.col("to_failure") + b * F.col("to_outcome")).alias("x"))
    return part(signals, 0.6, 0.4).unionByName(part(nodes, 0.4, 0.2)).groupBy("goal", "failure").agg(F.sum("x").alias("score"))


def ruled_out(aligned: DataFrame, keep: int = 3) -> DataFrame:
    """Failures with a score below 0.2, the first three, of goals whose best is below 0.3."""
    best = F.max("score").over(Window.partitionBy("goal"))
    order = Window.partitionBy("goal").orderBy("score", "failure")
    return aligned.withColumn("best", best).filter("best < 0.3 AND score < 0.2").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep).select("goal", "failure", "score")


def root_failure(failures_: DataFrame, temporal: DataFrame) -> DataFrame:
    """(goal, failure, score): the best of a goal's failures by 0.3 x specificity, + 0.4 with temporal context; losses last."""
    marked = failures_.join(temporal.withColumnRenamed("node", "failure").withColumn("timed", F.lit(True)), "failure", "left")
    score = F.round(0.3 * exprs.specificity(F.col("failure")) + F.when(F.col("timed"), 0.4).otherwise(0.0) - F.when(exprs.has_loss(F.col("failure")), 10.0).otherwise(0.0), 9)
    order = Window.partitionBy("goal").orderBy(F.desc("score"), "failure")
    return marked.withColumn("score", score).withColumn("n", F.row_number().over(order)).filter("n = 1").select("goal", "failure", "score")


def temporal_nodes(facts: DataFrame) -> DataFrame:
    own = facts.filter(F.col("p").isin(TEMPORAL))
    return own.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def dependents(facts: DataFrame) -> DataFrame:
    """(resource, dependent): who is powered by or requires a resource."""
    return facts.filter(F.col("p").isin(DEPENDENCY)).select(F.col("o").alias("resource"), F.col("s").alias("dependent")).distinct()


def survivors(dependents_: DataFrame, available: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Dependents of an available resource that need no unavailable one."""
    safe = dependents_.join(available, "resource", "left_semi").select("dependent").distinct()
    return safe.join(dependents_.join(unavailable, "resource", "left_semi").select("dependent").distinct(), "dependent", "left_anti")


def availability(facts: DataFrame) -> DataFrame:
    """(node, state): +1 or -1 by the first available / unavailable fact, else 0."""
    flag = F.when(F.col("p") == "available", F.when(exprs.boolean_concept(F.col("o")), 1).otherwise(-1)).when(F.col("p") == "unavailable", -1)
    return facts.groupBy(F.col("s").alias("node")).agg(F.coalesce(F.min_by(flag, F.when(flag.isNotNull(), F.col("seq"))), F.lit(0)).alias("state"))


def first_of_tiers(branches: list[DataFrame], by: list[str], value: str) -> DataFrame:
    """(by, value, tier): of several branches, the first that has an answer; the least value within it."""
    every = None
    for tier, branch in enumerate(branches):
        own = branch.select(*by, F.col(value), F.lit(tier).alias("tier"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(*by).agg(F.min(F.struct("tier", value)).alias("x")).select(*by, f"x.{value}", "x.tier")


def dispatch(goals: DataFrame, branches: list[tuple[str | None, DataFrame]]) -> DataFrame:
    """(goal, answer, tier): each goal's answer by the first branch that has one.

    goals (goal, cue); a branch (goal, answer) with a cue speaks only to goals of that cue.
    Answers and goals are dealt by goal once and sorted once: the least of a text has to be sorted for, before and after a shuffle if it is summed up before.
    """
    own = [branch.select("goal", F.lit(cue).cast("string").alias("needs"), F.lit(tier).alias("tier"), "answer") for tier, (cue, branch) in enumerate(branches)]
    asked = reduce(DataFrame.unionByName, own).repartition("goal").join(goals.select("goal", "cue").repartition("goal").hint("merge"), "goal").filter("needs IS NULL OR needs = cue")
    return asked.groupBy("goal").agg(F.min(F.struct("tier", "answer")).alias("x")).select("goal", "x.answer", "x.tier")


def richer_chain(structured: DataFrame, explained: DataFrame, ruled: DataFrame) -> DataFrame:
    """(target, chosen, chain): the chain with more distinct lines, the structured one of two equal ones, then the outcome.

    structured and explained: (target, lines array). The outcome line stays out for targets that are ruled out.
    """
    both = explained.select("target", F.array_distinct("lines").alias("e")).join(structured.select("target", F.array_distinct("lines").alias("s")), "target", "full")
    wins = F.coalesce(F.size("s"), F.lit(0)) >= F.coalesce(F.size("e"), F.lit(0))
    out = both.join(ruled.select("target").distinct().withColumn("out", F.lit(True)), "target", "left")
    lines = F.when(wins, F.col("s")).otherwise(F.col("e"))
    whole = F.when(F.col("out"), lines).otherwise(F.array_append(lines, F.concat(F.lit("outcome "), "target")))
    return out.select("target", F.when(wins, "structured").otherwise("explanation").alias("chosen"), F.array_join(whole, " | ").alias("chain"))
