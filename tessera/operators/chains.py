"""Chains over a graph composed of facts, rules, aliases, types and shared times; paths that meet in the middle; explanations with evidence.

Searches keep, per goal and node, a score and the node before it, never a path; paths are read back from the
rounds' tables at the end, for the goals that got there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .diagnose import TEMPORAL
from .ontology import alias_keys, cut, sized
from .store import by_predicate

#: What a step over an alias, a type or a shared time adds. Fixed values.
ALIAS, TYPE, BRIDGE = 0.05, 0.15, 0.25


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def known_symbols(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol): everything that stands on a side of a fact or rule."""
    sides = facts.select(F.explode(F.array("s", "o")).alias("symbol")).unionByName(rules.select(F.explode(F.array("ant.s", "ant.o", "con.s", "con.o")).alias("symbol")))
    return sides.filter("symbol IS NOT NULL").distinct()


def composed_edges(facts: DataFrame, rules: DataFrame, types: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(s, o, w, kind): the best edge of each pair of nodes.

    A fact leads from subject to object with the specificity of the more specific end and its predicate's dynamic weight
    (p, weight); a rule from the ends of its antecedent to those of its consequent, likewise; an alias and a type (id,
    type) with fixed weights. Booleans are no nodes. Times that nodes share are `times`, which are not paired here.
    """
    specific = lambda *ends: F.greatest(*[exprs.specificity(e) for e in ends])
    own = dynamic.select(exprs.local_name(F.col("p")).alias("local"), F.col("weight").alias("dynamic"))
    weighed = lambda df: by_predicate(df, own, "left", "local").select("s", "o", (F.col("base") + F.coalesce("dynamic", F.lit(0.0))).alias("w"), "kind")
    told = facts.select("s", "o", exprs.local_name(F.col("p")).alias("local"), specific(F.col("s"), F.col("o")).alias("base"), F.lit("fact").alias("kind"))
    concluded = rules.select(F.explode(F.array("ant.s", "ant.o")).alias("s"), "con").select("s", F.explode(F.array("con.s", "con.o")).alias("o"), exprs.local_name(F.col("con.p")).alias("local"), specific(F.col("con.s"), F.col("con.o")).alias("base"), F.lit("rule").alias("kind"))
    known = known_symbols(facts, rules)
    named = known.select(F.col("symbol").alias("s"), F.explode(alias_keys(F.col("symbol"))).alias("symbol")).join(known, "symbol", "left_semi").select("s", F.col("symbol").alias("o"), F.lit(ALIAS).alias("w"), F.lit("alias").alias("kind"))
    typed = types.select(F.col("id").alias("s"), F.col("type").alias("o"), F.lit(TYPE).alias("w"), F.lit("type").alias("kind"))
    every = union([weighed(told), weighed(concluded), named, typed]).filter((F.col("s") != F.col("o")) & exprs.boolean_concept(F.col("s")).isNull() & exprs.boolean_concept(F.col("o")).isNull())
    best = every.groupBy("s", "o").agg(F.max(F.struct(F.round("w", 9).alias("w"), "kind")).alias("x"))
    return best.select("s", "o", "x.w", "x.kind")


def times(facts: DataFrame) -> DataFrame:
    """(node, time): what is before, after or during what."""
    return facts.filter(exprs.local_name(F.col("p")).isin(TEMPORAL)).select(F.col("s").alias("node"), F.col("o").alias("time")).distinct()


def ways_back(targets: DataFrame, edges: DataFrame, members: DataFrame, depth: int, most: int) -> list[DataFrame]:
    """[(node, target)] by distance from 0: the nodes from which a target may be reached in that many steps and not in fewer.

    Ends after `depth` steps or before the first distance with more than `most` rows, so hubs around targets cost no more than that.
    """
    seen = frontier = cut(targets.select(F.col("target").alias("node"), "target").distinct())
    found = [frontier]
    for _ in range(depth):
        straight = frontier.join(edges.select(F.col("o").alias("node"), "s"), "node").select(F.col("s").alias("node"), "target")
        over = frontier.join(members, "node").select("time", "target").distinct().join(members, "time").select("node", "target")
        frontier = cut(straight.unionByName(over).distinct().join(seen, ["node", "target"], "left_anti"))
        if frontier.count() > most:
            break
        found.append(frontier)
        seen = seen.unionByName(frontier)
    return found


def over_times(level: DataFrame, members: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """(goal, node, score, before): steps of `level` (goal, node, score) to others at one of its times, or to those of `onto` only.

    A time with many nodes is reached by the two best of a goal's nodes only: whoever leaves by it came from the best node
    that is not itself. So a time costs its members per goal, not their pairs.
    """
    best = Window.partitionBy("goal", "time").orderBy(F.desc("score"), "node")
    there = level.join(members, "node").withColumn("place", F.row_number().over(best)).filter("place <= 2").select("goal", "target", "time", F.col("node").alias("before"), "score")
    away = there.join((members if onto is None else onto).select(F.col("node").alias("next"), "time"), "time").filter("next <> before")
    return away.select("goal", "target", F.col("next").alias("node"), F.round(F.col("score") + BRIDGE, 9).alias("score"), "before", F.lit("bridge").alias("kind"))


def best_walks(goals: DataFrame, edges: DataFrame, members: DataFrame, depth: int = 4) -> DataFrame:
    """(goal, score, hops, path, kinds): of the walks of at most `depth` steps from start to target, the one with the largest sum.

    goals (goal, start, target), each goal once. A round keeps a goal's best way to each node; a walk ends when it
    is at its target. Equal sums go to fewer steps, then to the name. Steps to where the target can't be reached any more aren't taken:
    what leads to the targets is searched back from them first, once for all goals of a target.
    """
    edges, members = cut(edges), cut(members)
    own = goals.select("goal", "target").filter("target IS NOT NULL")
    levels = [cut(goals.filter("start IS NOT NULL AND target IS NOT NULL").select("goal", "target", F.col("start").alias("node"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("kind")))]
    back = ways_back(own, edges, members, depth - 1, edges.count() + levels[0].count())
    for hops in range(1, depth + 1):
        useful = union(back[: depth - hops + 1]) if depth - hops < len(back) else None
        open_ = levels[-1].filter("node <> target").select("goal", "target", "node", "score")
        step = open_.join(edges.select(F.col("s").alias("node"), F.col("o").alias("next"), "w", "kind"), "node")
        step = step.select("goal", "target", F.col("next").alias("node"), F.round(F.col("score") + F.col("w"), 9).alias("score"), F.col("node").alias("before"), "kind")
        onto = None if useful is None else members.join(useful.select("node").distinct(), "node", "left_semi")
        every = step.unionByName(over_times(open_, members, onto))
        every = every.filter("node = target") if hops == depth else every if useful is None else every.join(useful, ["node", "target"], "left_semi")
        best = every.groupBy("goal", "target", "node").agg(F.max(F.struct("score", "before", "kind")).alias("x"))
        level = cut(best.select("goal", "target", "node", "x.score", "x.before", "x.kind"))
        if level.isEmpty():
            break
        levels.append(level)
    reached = union([levels[k].filter("node = target").select("goal", "target", "score", F.lit(k).alias("hops")) for k in range(1, len(levels))]) if len(levels) > 1 else levels[0].filter("false").select("goal", "target", "score", F.lit(0).alias("hops"))
    best = reached.groupBy("goal", "target").agg(F.max(F.struct("score", (-F.col("hops")).alias("less"))).alias("x")).select("goal", "target", "x.score", (-F.col("x.less")).alias("hops"))
    # From the target back, a round's table per step.
    back = cut(best.select("goal", "score", "hops", F.col("target").alias("node"), F.array("target").alias("path"), F.array().cast("array<string>").alias("kinds")))
    for k in range(len(levels) - 1, 0, -1):
        told = levels[k].select("goal", "node", "before", "kind")
        here = back.filter(F.col("hops") >= k).join(told, ["goal", "node"]).select("goal", "score", "hops", F.col("before").alias("node"), F.concat(F.array("before"), "path").alias("path"), F.concat(F.array("kind"), "kinds").alias("kinds"))
        back = here.unionByName(back.filter(F.col("hops") < k))
    return back.join(own.select("goal"), "goal", "left_semi").select("goal", "score", "hops", F.array_join("path", " > ").alias("path"), F.array_join("kinds", ",").alias("kinds"))


def meeting_paths(edges: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """(a, b, path, hops): a shortest undirected path of each pair of different nodes, searched from both ends.

    edges (s, o, seq) are read both ways. A pair's smaller frontier grows, until the two meet or `depth` steps are used, so a
    pair costs about twice the nodes at half its distance. Of several shortest paths, from b back each node is
    reached over the edge inserted first.
    """
    both = cut(edges.select("s", "o", "seq").unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"), "seq")).filter("s <> o").groupBy("s", "o").agg(F.min("seq").alias("seq")))
    # Written once, so that a pair's number stays; rounds carry it in place of both names.
    pairs = cut(pairs.select("a", "b").filter("a <> b").distinct().withColumn("pair", F.monotonically_increasing_id()))
    side = lambda end, back: pairs.select("pair", F.lit(back).alias("back"), F.col(end).alias("node"), F.lit(0).alias("dist"))
    # What is seen of pairs that have not met is all that a round has to look at.
    seen = open_ = frontier = cut(side("a", False).unionByName(side("b", True)))
    met: list[DataFrame] = []
    for _ in range(depth):
        size = frontier.groupBy("pair").agg(F.count_if("back").alias("n_back"), F.count_if(~F.col("back")).alias("n_on"))
        # A side without a frontier has seen all it can reach: its pair has no path.
        turn = size.filter("n_back > 0 AND n_on > 0").select("pair", (F.col("n_back") < F.col("n_on")).alias("turn"))
        marked = cut(frontier.join(turn, "pair"))
        growing, waiting = marked.filter("back = turn").drop("turn"), marked.filter("back <> turn").drop("turn")
        step = sized(growing, "node").join(both.select(F.col("s").alias("node"), F.col("o").alias("next")), "node").select("pair", "back", F.col("next").alias("node"), (F.col("dist") + 1).alias("dist")).distinct()
        new = cut(step.join(open_.select("pair", "back", "node"), ["pair", "back", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, open_ = seen.unionByName(new), open_.unionByName(new)
        other = waiting.select("pair", "node", (~F.col("back")).alias("back"), F.col("dist").alias("far"))
        hit = cut(new.join(other, ["pair", "node", "back"]).select("pair", "node", F.when(F.col("back"), F.col("far")).otherwise(F.col("dist")).alias("from_a"), F.when(F.col("back"), F.col("dist")).otherwise(F.col("far")).alias("from_b")))
        met.append(hit)
        frontier = new.unionByName(waiting)
        if not hit.isEmpty():
            done = hit.select("pair").distinct()
            frontier, open_ = cut(frontier.join(done, "pair", "left_anti")), cut(open_.join(done, "pair", "left_anti"))
        if frontier.isEmpty():
            break
    if not met:
        return pairs.limit(0).select("a", "b", F.col("a").alias("path"), F.lit(0).alias("hops"))
    meet = cut(union(met))
    # Nodes at each distance from a: all that a's side has seen, and of b's side those on a way to where they met.
    on_way = meet.select("pair", "node", F.col("from_a").alias("at"), F.col("from_b").alias("left"))
    found = meet.select("pair").distinct()
    known = [seen.filter("NOT back").join(found, "pair", "left_semi").select("pair", "node", F.col("dist").alias("at"))]
    b_side = cut(seen.filter("back").join(found, "pair", "left_semi").select("pair", "node", F.col("dist").alias("left")))
    for _ in range(depth):
        ahead = sized(on_way.filter("left > 0"), "node").join(both.select(F.col("s").alias("node"), F.col("o").alias("next")), "node").select("pair", F.col("next").alias("node"), (F.col("at") + 1).alias("at"), (F.col("left") - 1).alias("left"))
        on_way = cut(ahead.join(b_side, ["pair", "node", "left"], "left_semi").distinct())
        if on_way.isEmpty():
            break
        known.append(on_way.select("pair", "node", "at"))
    stations = cut(union(known).distinct())
    total = meet.groupBy("pair").agg(F.min(F.col("from_a") + F.col("from_b")).alias("hops"))
    back = cut(total.join(pairs.select("pair", F.col("b").alias("node")), "pair").select("pair", "hops", "node", F.col("hops").alias("at"), F.array("node").alias("path")))
    for _ in range(depth):
        going = sized(back.filter("at > 0"), F.array_join("path", ""))
        before = going.join(both.select(F.col("o").alias("node"), F.col("s").alias("before"), "seq"), "node").withColumn("at", F.col("at") - 1)
        before = before.join(stations.withColumnRenamed("node", "before"), ["pair", "before", "at"], "left_semi")
        # A pair has one path, which all its rows carry.
        best = before.groupBy("pair", "hops", "at").agg(F.min(F.struct("seq", "before", "path")).alias("x"))
        back = cut(best.select("pair", "hops", F.col("x.before").alias("node"), "at", F.concat(F.array("x.before"), "x.path").alias("path")).unionByName(back.filter("at = 0")))
        if back.filter("at > 0").isEmpty():
            break
    return back.filter("at = 0").join(pairs, "pair").select("a", "b", F.array_join("path", " > ").alias("path"), "hops")


def hop_evidence(hops: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """(cause, effect, evidence): temporal facts between the two as lines, in order of insertion, `most` at most."""
    timed = facts.filter(exprs.local_name(F.col("p")).isin(TEMPORAL)).select("s", "o", "seq", F.concat_ws(" ", "s", "p", "o").alias("line"))
    own = hops.select("cause", "effect").distinct()
    there = own.join(timed, (F.col("cause") == F.col("s")) & (F.col("effect") == F.col("o")))
    back = own.join(timed, (F.col("effect") == F.col("s")) & (F.col("cause") == F.col("o")))
    order = Window.partitionBy("cause", "effect").orderBy("seq", "line")
    each = there.unionByName(back).select("cause", "effect", "seq", "line").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return each.groupBy("cause", "effect").agg(lines.alias("evidence"))


def best_causes(candidates: DataFrame) -> DataFrame:
    """(effect, cause, kind, score, line): of candidates of kinds `fact` and `rule` the better; a rule wins a tie, then the earlier seq."""
    order = F.struct((-F.round("score", 9)).alias("less"), F.when(F.col("kind") == "rule", 0).otherwise(1).alias("second"), "seq", "cause")
    best = candidates.filter("cause IS NOT NULL AND cause <> effect").groupBy("effect").agg(F.min_by(F.struct("cause", "kind", "score", "line"), order).alias("x"))
    return best.select("effect", "x.*")


def explained(candidates: DataFrame, facts: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, lines, kinds, hops): from the effect to its best cause, hop by hop, each with its temporal evidence.

    candidates (effect, cause, kind, score, seq, line). A chain ends before a cause it has been at; a line
    stands once. A target without any cause has the temporal facts around it instead.
    """
    best = cut(best_causes(candidates))
    steps = best.join(hop_evidence(best, facts, depth), ["cause", "effect"], "left").select(F.col("effect").alias("at"), "cause", "kind", F.concat(F.array("line"), F.coalesce("evidence", F.array().cast("array<string>"))).alias("said"))
    none = F.array().cast("array<string>")
    chain = targets.select("target", F.array("target").alias("been"), F.col("target").alias("at"), none.alias("lines"), none.alias("kinds"))
    for _ in range(depth):
        go = F.col("cause").isNotNull() & ~F.array_contains("been", F.col("cause"))
        chain = chain.join(steps, "at", "left").select(
            "target", F.when(go, F.array_append("been", F.col("cause"))).otherwise(F.col("been")).alias("been"), F.when(go, F.col("cause")).alias("at"),
            F.when(go, F.concat("lines", "said")).otherwise(F.col("lines")).alias("lines"), F.when(go, F.array_append("kinds", F.col("kind"))).otherwise(F.col("kinds")).alias("kinds"),
        )
    timed = facts.filter(exprs.local_name(F.col("p")).isin(TEMPORAL)).select(F.explode(F.array("s", "o")).alias("target"), "seq", F.concat_ws(" ", "s", "p", "o").alias("line"))
    empty = chain.filter(F.size("lines") == 0).select("target")
    around = timed.join(empty, "target", "left_semi").distinct().withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("seq", "line"))).filter(F.col("n") <= depth)
    instead = around.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("instead"))
    out = chain.join(instead, "target", "left")
    return out.select("target", F.array_distinct(F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.coalesce("instead", none))).alias("lines"), F.array_join("kinds", ",").alias("kinds"), F.size("kinds").alias("hops"))

