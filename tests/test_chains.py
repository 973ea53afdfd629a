"""Chains over composed graphs, meeting paths and explanations against plain searches."""

import random
from itertools import pairwise

import pytest

from tessera.operators import chains, paths

FACT = "s string, p string, o string, conf double, seq long"
RULE = "ant struct<s:string,p:string,o:string>, con struct<s:string,p:string,o:string>, conf double, seq long"


def facts_of(spark, rows):
    return spark.createDataFrame([(s, p, o, 0.9, k) for k, (s, p, o) in enumerate(rows)], FACT)


def test_each_kind_of_edge_wins(spark):
    told = [
        ("entity:pump", "stops", "entity:valve"), ("entity:motor", "runs", "concept:fan"), ("entity:fans", "cools", "entity:room"), ("entity:rack", "holds", "entity:disk"), ("concept:drive", "fills", "entity:shelf"),
        ("entity:alarm", "during", "entity:night"), ("entity:guard", "during", "entity:night"), ("entity:guard", "calls", "entity:chief"), ("entity:lamp", "is", "concept:true"),
    ]
    rules = spark.createDataFrame([((("entity:leak", "fail", "concept:true")), ("entity:tank", "fail", "concept:true"), 0.8, 1)], RULE)
    types = spark.createDataFrame([("entity:disk", "concept:drive")], "id string, type string")
    dynamic = spark.createDataFrame([("stops", 0.5), ("fail", 0.3)], "p string, weight double")
    goals = [("fact", "entity:pump", "entity:valve"), ("alias", "entity:motor", "entity:room"), ("type", "entity:rack", "entity:shelf"), ("bridge", "entity:alarm", "entity:chief"), ("rule", "entity:leak", "entity:tank"), ("none", "entity:lamp", "concept:true"), ("null", None, "entity:room")]
    facts = facts_of(spark, told)
    got = {r.goal: r for r in chains.best_walks(spark.createDataFrame(goals, "goal string, start string, target string"), chains.composed_edges(facts, rules, types, dynamic), chains.times(facts)).collect()}
    # A walk may come back to where it was, so steps that add to the sum are taken again while there are steps left.
    assert {g: r.kinds for g, r in got.items()} == {"fact": "fact", "alias": "fact,alias,fact", "type": "fact,type,fact", "bridge": "bridge,bridge,bridge,fact", "rule": "rule"}
    assert {g: r.score for g, r in got.items()} == {"fact": 1.55, "alias": 2.15, "type": 2.25, "bridge": 1.8, "rule": 1.35}
    assert got["bridge"].path == "entity:alarm > entity:guard > entity:alarm > entity:guard > entity:chief"
    short = chains.best_walks(spark.createDataFrame(goals, "goal string, start string, target string"), chains.composed_edges(facts, rules, types, dynamic), chains.times(facts), depth=2).collect()
    assert ("bridge", "entity:alarm > entity:guard > entity:chief") in {(r.goal, r.path) for r in short}


def plain_walk(edges, members, start, target, depth):
    """Best (score, hops) of walks that end at their first visit of the target."""
    level, best = {start: 0.0}, None
    for hops in range(1, depth + 1):
        new = {}
        for node, score in level.items():
            if node == target:
                continue
            steps = [(o, w) for (s, o), w in edges.items() if s == node] + [(m, 0.25) for n, t in members if n == node for m, u in members if u == t and m != node]
            for o, w in steps:
                new[o] = max(new.get(o, -9), round(score + w, 9))
        level = new
        if target in level and (best is None or level[target] > best[0]):
            best = level[target], hops
    return best


def test_walks_on_random_graphs(spark):
    rng = random.Random(3)
    nodes = [f"entity:{c}" for c in "abcdefgh"]
    edges = {(s, o): round(rng.choice([-0.3, 0.1, 0.4, 0.7]), 9) for s, o in {tuple(rng.sample(nodes, 2)) for _ in range(14)}}
    members = [(n, f"t{rng.randint(0, 2)}") for n in nodes[:5]]
    goals = [(f"g{k}", *rng.sample(nodes, 2)) for k in range(25)]
    table = spark.createDataFrame([(s, o, w, "fact") for (s, o), w in edges.items()], "s string, o string, w double, kind string")
    got = {r.goal: (r.score, r.hops) for r in chains.best_walks(spark.createDataFrame(goals, "goal string, start string, target string"), table, spark.createDataFrame(members, "node string, time string")).collect()}
    assert got == {g: found for g, a, b in goals if (found := plain_walk(edges, members, a, b, 4))}


def test_a_time_with_many_nodes_does_not_pair(spark):
    """20,000 nodes at one time cost a goal 20,000 rows in a round, not their pairs."""
    members = spark.range(20_000).selectExpr("concat('entity:n', id) AS node", "'now' AS time")
    level = spark.range(2_000).selectExpr("1L AS goal", "'x' AS target", "concat('entity:n', id) AS node", "id / 1000.0D AS score")
    got = chains.over_times(level, members)
    assert got.count() <= 2 * 20_000
    assert got.groupBy("node").agg({"score": "max"}).count() == 20_000


def test_meeting_paths_equal_one_sided_search(spark):
    rng = random.Random(5)
    nodes = [f"n{k:02d}" for k in range(24)]
    rows = [(*rng.sample(nodes, 2), k) for k in range(30)]
    edges = spark.createDataFrame(rows, "s string, o string, seq long")
    pairs = spark.createDataFrame([(a, b) for a in nodes[:8] for b in nodes if a != b] + [("n00", "away")], "a string, b string")
    got = sorted(tuple(r) for r in chains.meeting_paths(edges, pairs).collect())
    expected = sorted(tuple(r) for r in paths.shortest_paths(edges, pairs).filter("hops > 0").collect())
    assert [(a, b, h) for a, b, _, h in got] == [(a, b, h) for a, b, _, h in expected]
    there = {frozenset(r[:2]) for r in rows}
    for a, b, path, hops in got:
        walk = path.split(" > ")
        assert walk[0] == a and walk[-1] == b and len(walk) == hops + 1 and all(frozenset(x) in there for x in pairwise(walk))
    assert got == expected


def test_meeting_paths_leave_a_hub_alone(spark, monkeypatch):
    """A start in a chain whose other side hangs at a hub of 3,000: only the small side grows."""
    seen = []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: seen.append(real(df)) or seen[-1])
    hub = [("hub", f"leaf{k}", k) for k in range(3_000)] + [("hub", "c0", 9_000)] + [(f"c{k}", f"c{k + 1}", 9_001 + k) for k in range(4)]
    edges = spark.createDataFrame(hub, "s string, o string, seq long")
    got = chains.meeting_paths(edges, spark.createDataFrame([("c4", "hub")], "a string, b string")).collect()
    assert [(r.path, r.hops) for r in got] == [("c4 > c3 > c2 > c1 > c0 > hub", 5)]
    assert max(df.count() for df in seen[1:] if "back" in df.columns) <= 3_001 and sum(df.count() for df in seen[1:] if "back" in df.columns) < 3_100


def test_explanations(spark):
    """A rule wins a tie; evidence follows its hop; loops end; a target without a cause has what is around it."""
    facts = facts_of(spark, [("a", "before", "b"), ("b", "after", "a"), ("b", "before", "c"), ("x", "during", "y")])
    rows = [("c", "b", "fact", 1.0, 1, "b causes c"), ("c", "z", "rule", 0.9, 2, "if z then c"), ("b", "a", "rule", 0.7, 3, "if a then b"), ("b", "q", "fact", 0.7, 4, "q causes b"), ("a", "c", "fact", 0.5, 5, "c causes a")]
    given = spark.createDataFrame(rows, "effect string, cause string, kind string, score double, seq long, line string")
    got = {r.target: (r.lines, r.kinds, r.hops) for r in chains.explained(given, facts, spark.createDataFrame([("c",), ("x",), ("none",)], "target string"), 4).collect()}
    assert got == {"c": (["b causes c", "b before c", "if a then b", "a before b", "b after a"], "fact,rule", 2), "x": (["x during y"], "", 0), "none": ([], "", 0)}


@pytest.mark.parametrize("most", [0, 1_000])
def test_only_steps_towards_the_target_are_taken(spark, monkeypatch, most):
    """Nodes from which the target is out of reach are in no round's table; where too many lead to it they may be, with the same result."""
    edges = spark.createDataFrame([("a", "b", 0.5, "fact"), ("b", "t", 0.5, "fact"), *[("a", f"x{i}", 0.9, "fact") for i in range(50)], *[(f"x{i}", f"y{i}", 0.9, "fact") for i in range(50)]], "s string, o string, w double, kind string")
    members = spark.createDataFrame([("a", "noon"), ("c", "noon"), ("x1", "noon")], "node string, time string")
    goals = spark.createDataFrame([("g", "a", "t")], "goal string, start string, target string")
    cuts, cut, back = [], chains.cut, chains.ways_back
    monkeypatch.setattr(chains, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    monkeypatch.setattr(chains, "ways_back", lambda *args: back(*args[:-1], most if most == 0 else args[-1]), raising=False)
    got = chains.best_walks(goals, edges, members, depth=3).collect()
    assert [(r["score"], r["hops"], r["path"]) for r in got] == [(1.0, 2, "a > b > t")]
    rounds = [df for df in cuts if {"goal", "node", "before"} <= set(df.columns)]
    assert (max(df.count() for df in rounds) == 1) == (most > 0)


def test_meeting_paths_rounds_carry_numbers_and_open_pairs(spark, monkeypatch):
    """A round's rows name neither end of their pair, and pairs that have met aren't looked at again."""
    rows, cut = [], chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rows.append(cut(df)) or rows[-1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(8)], "s string, o string, seq long")
    got = chains.meeting_paths(edges, spark.createDataFrame([("n0", "n1"), ("n0", "n5")], "a string, b string"))
    assert sorted(tuple(r) for r in got.collect()) == [("n0", "n1", "n0 > n1", 1), ("n0", "n5", "n0 > n1 > n2 > n3 > n4 > n5", 5)]
    sides = [df for df in rows if "back" in df.columns]
    assert sides and all("a" not in df.columns and "b" not in df.columns for df in sides)
    assert all(df.select("pair").distinct().count() <= 1 for df in sides[3:])
