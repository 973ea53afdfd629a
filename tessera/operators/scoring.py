"""Scores, softmax, ranks and winners of candidates, per goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, specificity


def query_match(gtype: Column, entity: Column, relation: Column, fit: Column) -> Column:
    """entity x relation x type for relation and place goals; constants for the other kinds."""
    product = clamp(entity * relation * fit)
    return F.when(gtype == "UNKNOWN", 1.0).when(gtype == "YESNO", 1.0).when(gtype.isin("ATTRIBUTE", "COUNT"), 0.5).otherwise(product)


def type_score(fit: Column) -> Column:
    return F.when(fit, 1.0).when(~fit, 0.2).otherwise(0.8)


def softmax(df: DataFrame, goal: str = "goal_id", score: str = "score") -> DataFrame:
    """Adds prob: exp(score - max) / sum, per goal."""
    own = Window.partitionBy(goal)
    e = F.exp(F.col(score) - F.max(score).over(own))
    return df.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(own)).drop("e")


def rank(df: DataFrame, goal: str = "goal_id", payload: str = "answer") -> DataFrame:
    """Adds rank: score down, ontology support up, evidence down, depth up, producer up, payload up.

    Columns that a table lacks count as equal.
    """
    have = lambda name, order: [order(name)] if name in df.columns else []
    order = [F.desc("score"), *have("ontology_support", F.asc), *have("n_evidence", F.desc), *have("depth", F.asc), *have("producer", F.asc), F.asc(payload)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(goal).orderBy(*order)).cast("long"))


def winner(ranked: DataFrame, goal: str = "goal_id") -> DataFrame:
    """First ANSWER, else first QUERY_PLAN, else (if a SUBGOAL leads) the first ASSERTION, else the leader."""
    leads = F.first("ctype").over(Window.partitionBy(goal).orderBy("rank"))
    place = F.when(F.col("ctype") == "ANSWER", 0).when(F.col("ctype") == "QUERY_PLAN", 1).when((F.col("ctype") == "ASSERTION") & (F.col("leader") == "SUBGOAL"), 2).otherwise(3)
    own = Window.partitionBy(goal).orderBy("place", "rank")
    return ranked.withColumn("leader", leads).withColumn("place", place).withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n", "place", "leader")


def statement_winner(ranked: DataFrame, goal: str = "goal_id") -> DataFrame:
    """The insertion candidate wins whatever its score; else the leader."""
    own = Window.partitionBy(goal).orderBy(F.when(F.col("ctype") == "ASSERTION", 0).otherwise(1), "rank")
    return ranked.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


def best_answer(ranked: DataFrame, goal: str = "goal_id", payload: str = "answer") -> DataFrame:
    """By softmax score plus 0.05 x specificity; the earlier rank on ties."""
    total = F.col("prob") + 0.05 * specificity(F.col(payload))
    own = Window.partitionBy(goal).orderBy(F.desc("total"), "rank")
    return ranked.withColumn("total", F.round(total, 9)).withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


def multi_answer(candidates: DataFrame, goal: str = "goal_id", payload: str = "answer") -> DataFrame:
    """(goal, text, n): distinct answers, the most specific first, joined by commas."""
    each = candidates.select(goal, payload).distinct().withColumn("order", F.round(-specificity(F.col(payload)), 9))
    own = each.groupBy(goal).agg(F.array_sort(F.collect_list(F.struct("order", payload))).alias("all"))
    return own.select(goal, F.array_join(F.transform("all", lambda x: x[payload]), ", ").alias("text"), F.size("all").cast("long").alias("n"))


def evidence(candidates: DataFrame, goal: str = "goal_id", keep: int = 3) -> DataFrame:
    """(goal, evidence): of the winner, then of the others by rank, each once, the first `keep`."""
    each = candidates.groupBy(goal, "evidence").agg(F.min("rank").alias("rank"))
    own = each.withColumn("n", F.row_number().over(Window.partitionBy(goal).orderBy("rank", "evidence"))).filter(F.col("n") <= keep)
    return own.groupBy(goal).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence"))), lambda x: x["evidence"]), "; ").alias("evidence"))


def top_specific(df: DataFrame, by: str, value: str, keep: int, without_losses: bool = False) -> DataFrame:
    from ..functions.exprs import has_loss

    own = df.filter(~has_loss(F.col(value))) if without_losses else df
    scored = own.withColumn("specificity", F.round(specificity(F.col(value)), 6))
    order = Window.partitionBy(by).orderBy(F.desc("specificity"), value)
    return scored.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= keep)
