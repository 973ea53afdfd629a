"""Path searches as bounded rounds of joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ontology import cut


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """(a, b, path, hops): a shortest undirected path of each pair; ties go to the edge inserted first.

    edges (s, o, seq) are read both ways; a node is reached once per start, through its first parent.
    """
    both = edges.select("s", "o", "seq").unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"), "seq")).groupBy("s", "o").agg(F.min("seq").alias("seq"))
    starts = pairs.select(F.col("a").alias("start")).distinct()
    seen = frontier = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    for _ in range(depth):
        step = frontier.join(both, F.col("node") == F.col("s")).groupBy("start", F.col("o").alias("next")).agg(F.min_by("path", F.struct("seq", "s")).alias("path"))
        new = step.select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        frontier = cut(new.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = pairs.join(seen, (F.col("a") == F.col("start")) & (F.col("b") == F.col("node")))
    return found.select("a", "b", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("hops"))


def best_chains(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(start, node, score, path, hops): of the chains of at most `depth` edges, the one with the largest sum.

    edges (s, o, w). Weights may be negative, so every (start, node, hops) keeps its best, then the best over hops.
    """
    best_edge = edges.filter("s <> o").groupBy("s", "o").agg(F.max("w").alias("w"))
    level = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("score"), F.array("start").alias("path"))
    found = None
    for hops in range(1, depth + 1):
        step = level.join(best_edge, F.col("node") == F.col("s")).filter(~F.array_contains("path", F.col("o")))
        grown = step.select("start", F.col("o").alias("node"), (F.col("score") + F.col("w")).alias("score"), F.array_append("path", F.col("o")).alias("path"))
        level = cut(grown.groupBy("start", "node").agg(F.max(F.struct(F.round("score", 9).alias("score"), "path")).alias("x")).select("start", "node", "x.*"))
        if level.isEmpty():
            break
        own = level.withColumn("hops", F.lit(hops))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return level.withColumn("hops", F.lit(0)).limit(0)
    return found.groupBy("start", "node").agg(F.max(F.struct("score", (-F.col("hops")).alias("less"), "path")).alias("x")).select("start", "node", "x.score", F.array_join("x.path", " > ").alias("path"), (-F.col("x.less")).alias("hops"))


def ancestry(causes: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(target, cause, dist): causes (cause, effect) backwards from each target; the last one found."""
    frontier = targets.select("target", F.col("target").alias("node"))
    seen = frontier.select("target", "node")
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(causes, F.col("node") == F.col("effect")).select("target", F.col("cause").alias("node")).distinct()
        frontier = cut(step.join(seen, ["target", "node"], "left_anti"))
        own = frontier.withColumn("dist", F.lit(d))
        found = own if found is None else found.unionByName(own)
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found.groupBy("target").agg(F.max(F.struct("dist", "node")).alias("x")).select("target", F.col("x.node").alias("cause"), "x.dist")


def explanation(causes: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, chain, hops): from the effect to its best cause, hop by hop, without revisits.

    causes (cause, effect, score); the best cause per effect is by score, then name.
    """
    best = causes.groupBy("effect").agg(F.max_by("cause", F.struct("score", "cause")).alias("cause"))
    chain = targets.select("target", F.array("target").alias("chain"), F.col("target").alias("at"))
    for _ in range(depth):
        go = F.col("cause").isNotNull() & ~F.array_contains("chain", F.col("cause"))
        chain = chain.join(best, F.col("at") == F.col("effect"), "left").select(
            "target", F.when(go, F.array_append("chain", F.col("cause"))).otherwise(F.col("chain")).alias("chain"), F.when(go, F.col("cause")).alias("at")
        )
    return chain.select("target", F.array_join("chain", " < ").alias("chain"), (F.size("chain") - 1).alias("hops"))
