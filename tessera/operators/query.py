"""Answers a table of goals against the fact table: rewrites, relation, yes/no, count, attribute, place.

Goals are rows (goal_id, subject, predicate, object, expected_type, ...), null where a side is open.
Every head returns candidates (goal_id, answer, s, p, o, conf, seq, head_score, ...). Rewrites and
type closures are small axiom tables; joins with facts are equi-joins on predicate and a bound side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import mean_score, specificity
from .ontology import cut

NEUTRAL_FOCUS = 0.6


def rewrites(predicates: DataFrame, flags: DataFrame, inverse: DataFrame, subprop: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(p, p2, swap, qmatch): predicates that also answer p.

    Direct ones, sub-properties, aliases, and symmetric ones swapped 1.0; inverses and their
    sub-properties swapped 0.9. Of several ways to one (p, p2, swap) the best stays.
    """
    own = predicates.select("p").distinct()
    way = lambda df, p2, swap, q: df.select("p", p2.alias("p2"), F.lit(swap).alias("swap"), F.lit(q).alias("qmatch"))
    inverses = inverse.select("p", "inv").union(inverse.select(F.col("inv").alias("p"), F.col("p").alias("inv"))).distinct()
    below = subprop.select(F.col("parent"), F.col("child"))
    found = way(own, F.col("p"), False, 1.0)
    found = found.union(way(own.join(below, F.col("p") == F.col("parent")), F.col("child"), False, 1.0))
    found = found.union(way(own.join(flags.filter("symmetric").select("p"), "p"), F.col("p"), True, 1.0))
    turned = own.join(inverses, "p")
    found = found.union(way(turned, F.col("inv"), True, 0.9))
    found = found.union(way(turned.join(below, F.col("inv") == F.col("parent")), F.col("child"), True, 0.9))
    if aliases is not None:
        found = found.union(way(own.join(aliases, "p"), F.col("alias"), False, 1.0))
    return found.groupBy("p", "p2", "swap").agg(F.max("qmatch").alias("qmatch"))


def matched(goals: DataFrame, facts: DataFrame, rewrite: DataFrame) -> DataFrame:
    """(predicate, qmatch, a: near end, b: far end, s, p, o, conf, seq): facts under every predicate asked for that they answer.

    The few rewrites of the goals' predicates meet the facts first, so that only facts of these predicates,
    and only in the directions asked for, are shuffled to the goals.
    """
    asked = rewrite.join(goals.select(F.col("predicate").alias("p")).distinct(), "p", "left_semi").select(F.col("p").alias("predicate"), F.col("p2").alias("p"), "swap", "qmatch")
    end = lambda swapped, straight: F.when(F.col("swap"), F.col(swapped)).otherwise(F.col(straight))
    return facts.join(asked, "p").select("predicate", "qmatch", end("o", "s").alias("a"), end("s", "o").alias("b"), "s", "p", "o", "conf", "seq")


def relation_query(goals: DataFrame, facts: DataFrame, rewrite: DataFrame) -> DataFrame:
    """Subject-bound goals give objects, object-bound goals give subjects; goals with both sides only check."""
    found = matched(goals, facts, rewrite)
    cols = ["goal_id", "qmatch", *[c for c in ("expected_type",) if c in goals.columns], "s", "p", "o", "conf", "seq"]
    left = goals.filter("subject IS NOT NULL AND object IS NULL").withColumnRenamed("subject", "a").join(found, ["predicate", "a"])
    right = goals.filter("object IS NOT NULL AND subject IS NULL").withColumnRenamed("object", "b").join(found, ["predicate", "b"])
    return left.select(*cols, F.col("b").alias("answer")).unionByName(right.select(*cols, F.col("a").alias("answer")))


def symmetric_fallback(goals: DataFrame, candidates: DataFrame, facts: DataFrame, symmetric: DataFrame) -> DataFrame:
    """For object-bound goals without an answer: facts of a symmetric predicate that have the object as subject, at 0.85."""
    open_ = goals.filter("object IS NOT NULL AND subject IS NULL").join(candidates.select("goal_id").distinct(), "goal_id", "left_anti")
    asked = open_.join(symmetric.select(F.col("p").alias("predicate")), "predicate", "left_semi")
    found = asked.join(facts, (F.col("predicate") == F.col("p")) & (F.col("object") == F.col("s")))
    return found.select("goal_id", F.lit(0.85).alias("qmatch"), "s", "p", "o", "conf", "seq", F.col("o").alias("answer"))


def open_query(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """Neither side bound: subjects of the predicate."""
    open_ = goals.filter("subject IS NULL AND object IS NULL")
    return open_.join(facts, F.col("predicate") == F.col("p")).select("goal_id", F.lit(1.0).alias("qmatch"), "s", "p", "o", "conf", "seq", F.col("s").alias("answer"))


def yes_no(goals: DataFrame, facts: DataFrame, rewrite: DataFrame) -> DataFrame:
    """(goal_id, answer, score): "Yes, ..." with the first matching fact, else "Unknown."."""
    asked = goals.select("goal_id", "predicate", F.col("subject").alias("a"), F.col("object").alias("b"))
    hits = asked.join(matched(goals, facts, rewrite), ["predicate", "a", "b"])
    first = hits.groupBy("goal_id").agg(F.min_by("conf", "seq").alias("conf"))
    return goals.join(first, "goal_id", "left").select(
        "goal_id",
        F.when(F.col("conf").isNull(), "Unknown.").otherwise(F.concat_ws(" ", F.lit("Yes,"), "subject", "predicate", "object")).alias("answer"),
        mean_score(F.lit(1.0), F.col("conf")).alias("score"),
    )


def count_query(goals: DataFrame, candidates: DataFrame) -> DataFrame:
    """(goal_id, n): distinct answers of every goal; none is 0."""
    return goals.select("goal_id").join(candidates.groupBy("goal_id").agg(F.count_distinct("answer").alias("n")), "goal_id", "left").select("goal_id", F.coalesce("n", F.lit(0)).alias("n"))


def attribute_query(goals: DataFrame, facts: DataFrame, family: list[str]) -> DataFrame:
    hits = goals.join(facts.filter(F.col("p").isin(family)), F.col("subject") == F.col("s"))
    return hits.select("goal_id", F.regexp_replace("o", "^(entity|concept):", "").alias("answer"), mean_score(F.col("conf"), F.lit(NEUTRAL_FOCUS)).alias("head_score"))


def with_modifier(candidates: DataFrame, goals: DataFrame, attributes: DataFrame) -> DataFrame:
    """Candidates of goals whose modifier, if any, is an attribute of the answer; else/other/another are none."""
    wanted = goals.select("goal_id", F.when(~F.lower("modifier").isin("else", "other", "another"), F.lower("modifier")).alias("modifier"))
    value = attributes.select(F.col("s").alias("answer"), F.lower(F.regexp_replace("o", "^(entity|concept):", "")).alias("modifier")).distinct()
    asked = candidates.join(wanted, "goal_id")
    free = asked.filter("modifier IS NULL")
    return free.unionByName(asked.filter("modifier IS NOT NULL").join(value, ["answer", "modifier"], "left_semi"))


def typed(candidates: DataFrame, goals: DataFrame, types: DataFrame, compatible: DataFrame) -> DataFrame:
    """Adds type_fit: null without expectation or without a type of the answer, else whether one fits.

    types (id, type); compatible (type, wider) holds each type with itself and what it is below.
    """
    wide = types.join(compatible, "type").groupBy(F.col("id").alias("answer")).agg(F.collect_set("wider").alias("wide"))  # a few types per entity
    asked = candidates if "expected_type" in candidates.columns else candidates.join(goals.select("goal_id", "expected_type"), "goal_id")
    fit = F.when(F.col("expected_type").isNotNull() & F.col("wide").isNotNull(), F.array_contains("wide", F.col("expected_type")))
    return asked.join(wide, "answer", "left").withColumn("type_fit", fit).drop("wide")


def valid_goals(goals: DataFrame) -> DataFrame:
    """Adds `checked`: the goal's type if it has what that type needs, else UNKNOWN."""
    has = lambda *names: F.lit(True) if not names else F.col(names[0]).isNotNull() & has(*names[1:])
    side = F.col("subject").isNotNull() | F.col("object").isNotNull()
    ok = (
        F.when(F.col("gtype") == "WHERE", has("entity_type"))
        .when(F.col("gtype").isin("RELATION", "COUNT"), has("predicate") & side)
        .when(F.col("gtype") == "ATTRIBUTE", has("subject", "attribute"))
        .when(F.col("gtype") == "YESNO", has("subject", "predicate", "object"))
    )
    return goals.withColumn("checked", F.when(ok, F.col("gtype")).otherwise("UNKNOWN"))


def echo_free(candidates: DataFrame, goals: DataFrame) -> DataFrame:
    """Without answers equal to the goal's own sides, unless a goal has no others."""
    own = candidates.join(goals.select("goal_id", "subject", "object"), "goal_id")
    keep = ~(F.col("answer").eqNullSafe(F.col("subject")) | F.col("answer").eqNullSafe(F.col("object")))
    best = F.max(keep).over(Window.partitionBy("goal_id"))
    return own.withColumn("keep", keep).withColumn("any", best).filter(F.col("keep") | ~F.col("any")).drop("keep", "any", "subject", "object")


def unseen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Without answers that the same query key got before."""
    return candidates.join(history.select("key", "answer").distinct(), ["key", "answer"], "left_anti")


def colocation_transfer(facts: DataFrame, colocation: list[str], location: list[str]) -> DataFrame:
    """(subject, location, conf): of a colocated pair, the place of one is the place of the other."""
    together = facts.filter(F.col("p").isin(colocation))
    placed = facts.filter(F.col("p").isin(location)).select(F.col("s").alias("there"), F.col("o").alias("location"), F.col("conf").alias("conf2"))
    ends = together.select(F.col("s").alias("subject"), F.col("o").alias("there"), "conf").unionByName(together.select(F.col("o").alias("subject"), F.col("s").alias("there"), "conf"))
    return ends.join(placed, "there").groupBy("subject", "location").agg(F.max((F.col("conf") + F.col("conf2")) / 2).alias("conf"))


def location_chain(facts: DataFrame, location: list[str], depth: int = 6) -> DataFrame:
    """(subject, predicate, terminal, conf, hops): each subject's chain of first-inserted places.

    A chain ends at a node without a place, at a node seen before, or after `depth` steps.
    """
    edges = facts.filter(F.col("p").isin(location)).groupBy("s").agg(F.min_by(F.struct("p", "o", "conf"), "seq").alias("e")).select("s", "e.*")
    chain = edges.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("terminal"), F.col("conf").alias("total"), F.lit(1).alias("hops"), F.array("s", "o").alias("seen"))
    for _ in range(depth - 1):
        step = edges.select(F.col("s").alias("terminal"), F.col("p").alias("p2"), F.col("o").alias("o2"), F.col("conf").alias("conf2"))
        go = F.col("o2").isNotNull() & ~F.array_contains("seen", F.col("o2"))
        chain = chain.join(step, "terminal", "left").select(
            "subject",
            F.when(go, F.col("p2")).otherwise(F.col("predicate")).alias("predicate"),
            F.when(go, F.col("o2")).otherwise(F.col("terminal")).alias("terminal"),
            (F.col("total") + F.when(go, F.col("conf2")).otherwise(0.0)).alias("total"),
            (F.col("hops") + F.when(go, 1).otherwise(0)).alias("hops"),
            F.when(go, F.array_append("seen", F.col("o2"))).otherwise(F.col("seen")).alias("seen"),
        )
    conf = F.least(F.lit(1.0), F.col("total") / F.col("hops") + 0.05 * (F.col("hops") - 1))
    return chain.select("subject", "predicate", "terminal", conf.alias("conf"), "hops")


def subgoals(goals: DataFrame, types: DataFrame, facts: DataFrame, colocation: list[str]) -> DataFrame:
    """WHERE goals of a type expand to a goal for each partner of their entities: (goal_id, target, target_type, depth, score)."""
    own = goals.join(types, F.col("entity_type") == F.col("type")).select("goal_id", "depth", "id")
    together = facts.filter(F.col("p").isin(colocation))
    ends = together.select(F.col("s").alias("id"), F.col("o").alias("target"), "conf").unionByName(together.select(F.col("o").alias("id"), F.col("s").alias("target"), "conf"))
    found = own.join(ends, "id").groupBy("goal_id", "target").agg(F.max("conf").alias("conf"), F.max("depth").alias("depth"))
    kinds = types.groupBy("id").agg(F.min("type").alias("target_type")).withColumnRenamed("id", "target")
    named = F.coalesce("target_type", F.concat(F.lit("concept:"), F.regexp_replace("target", "^entity:", "")))
    return found.join(kinds, "target", "left").select("goal_id", "target", named.alias("target_type"), (F.col("depth") + 1).alias("depth"), mean_score(F.col("conf"), F.lit(0.6)).alias("score"))


def direct_relation(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """Local-name equality; a bound subject gives the object, else a bound object the subject, else the subject."""
    named = facts.withColumn("p_local", F.lower(F.regexp_extract("p", r"[^#/]*$", 0)))
    asked = goals.withColumn("p_local", F.lower(F.regexp_extract("predicate", r"[^#/]*$", 0)))
    cols = ["goal_id", "s", "p", "o", "conf", "seq"]
    by_s = asked.filter("subject IS NOT NULL").join(named, (asked.p_local == named.p_local) & (asked.subject == named.s)).select(*cols, F.col("o").alias("answer"))
    by_o = asked.filter("object IS NOT NULL").join(named, (asked.p_local == named.p_local) & (asked.object == named.o)).filter("subject IS NULL OR subject <> s").select(*cols, F.col("s").alias("answer"))
    free = asked.filter("subject IS NULL AND object IS NULL").join(named, "p_local").select(*cols, F.col("s").alias("answer"))
    return by_s.unionByName(by_o).unionByName(free)


def direct_rule(goals: DataFrame, rules: DataFrame) -> DataFrame:
    """(goal_id, answer): rule consequents and antecedents (s, p, o, conf, seq, side) asked like facts.

    Answers that repeat the goal's own sides go if there are others; the most specific one stays.
    """
    found = direct_relation(goals, rules.drop("side")).select("goal_id", "answer").distinct()
    own = echo_free(found, goals).withColumn("specific", F.round(specificity(F.col("answer")), 6))
    return own.groupBy("goal_id").agg(F.max(F.struct("specific", "answer")).alias("x")).select("goal_id", "x.answer")


def resolve(goals: DataFrame, facts: DataFrame, colocation: list[str], location: list[str], rounds: int = 3) -> DataFrame:
    """(goal_id, place, hops): WHERE goals (goal_id, subject), all in one job per round.

    A goal whose subject has a place is answered. The others ask for the places of the subject's
    partners, then of theirs; a partner's answer becomes the subject's. Places spread over the nodes,
    once for all goals: a node takes those of its nearest placed partners, and the goals join at the end.
    """
    placed = facts.filter(F.col("p").isin(location)).select(F.col("s").alias("node"), F.col("o").alias("place"))
    together = facts.filter(F.col("p").isin(colocation))
    partners = together.select(F.col("s").alias("node"), F.col("o").alias("next")).unionByName(together.select(F.col("o").alias("node"), F.col("s").alias("next")))
    last = known = cut(placed.distinct().withColumn("hops", F.lit(0)))
    # Only nodes still without a place look at their partners.
    open_ = cut(partners.join(known.select("node").distinct(), "node", "left_anti"))
    for hops in range(1, rounds + 1):
        step = open_.join(last.select(F.col("node").alias("next"), "place"), "next").select("node", "place").distinct()
        last = cut(step.withColumn("hops", F.lit(hops)))
        if last.isEmpty():
            break
        known = known.unionByName(last)
        open_ = open_.join(last.select("node").distinct(), "node", "left_anti")
    return goals.select("goal_id", F.col("subject").alias("node")).join(known, "node").select("goal_id", "place", "hops")


def bridge_members(facts: DataFrame) -> DataFrame:
    """(o, node): which nodes are before, after or during what."""
    return facts.filter(F.col("p").isin("before", "after", "during")).select("o", F.col("s").alias("node")).distinct()


def temporal_bridge(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, o): what two asked nodes (a, b) are both before, after or during.

    The nodes of an object stay its members; only asked pairs are made, by two equi-joins, so an object with very many
    nodes costs as many rows as it has and not their pairs.
    """
    members = bridge_members(facts)
    ends = asked.select("a", "b").filter("a <> b").distinct()
    return ends.join(members.withColumnRenamed("node", "a"), "a").join(members.withColumnRenamed("node", "b"), ["b", "o"], "left_semi").select("a", "b", "o")


def predicate_between(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, p): the first fact's predicate between two entities, in either direction."""
    ends = facts.select(F.col("s").alias("a"), F.col("o").alias("b"), "p", "seq").unionByName(facts.select(F.col("o").alias("a"), F.col("s").alias("b"), "p", "seq"))
    return pairs.join(ends, ["a", "b"], "left").groupBy("a", "b").agg(F.min_by("p", "seq").alias("p"))


def predicate_priority(p: Column) -> Column:
    """contain 0, control and use 1, spatial 2, type 3, others 10, none 50."""
    local = F.lower(F.regexp_extract(p, r"[^#/]*$", 0))
    return (
        F.when(p.isNull(), 50).when(local.contains("contain"), 0).when(local.rlike("control|use"), 1)
        .when(local.isin("in", "at", "on", "inside", "locatedin", "near", "with", "under"), 2).when(local == "type", 3).otherwise(10)
    )
