"""Two steps by lists of ends, against all pairs; components whose names aren't broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ontology, rules


@pytest.mark.parametrize("listed", [1_000_000, 5])
def test_ends_are_each_once(spark, monkeypatch, listed):
    """Repeated rows, an `a` and a `b` with very many others, nulls; in one block and in many."""
    monkeypatch.setattr(rules, "LISTED", listed)
    rng = random.Random(3)
    first = [(rng.randrange(12), rng.randrange(9)) for _ in range(60)] + [(1, b) for b in range(9)] + [(None, 2), (3, None), (4, 100)]
    second = [(rng.randrange(9), rng.randrange(40)) for _ in range(90)] + [(2, c) for c in range(40)] + [(None, 1), (5, None)]
    facts = spark.createDataFrame([(a, "requires", b) for a, b in first] + [(b, "with", c) for b, c in second], "s long, p string, o long").withColumn("conf", F.lit(0.9))
    rule = rules.Rule("r", (("?a", "requires", "?b"), ("?b", "with", "?c")), ("?a", "dependsOn", "?c"), 0.9)
    expected = {(a, c) for a, b in first for d, c in second if b is not None and b == d}
    got = [(r.s, r.o) for r in rules.conclusions(facts, rule).collect()]
    assert len(got) == len(expected) and set(got) == expected
    old = rules.best_per_fact(rules.apply(facts, rule))
    assert {(r.s, r.o) for r in old.select("s", "o").collect()} == expected
    ends = rules.chain_ends(*[spark.createDataFrame(rows, f"{x} long, {y} long") for rows, x, y in ((first, "a", "b"), (second, "b", "c"))])
    assert ends.count() == len({r.a for r in ends.collect()}) if listed > 5 else ends.count() > 13


def test_lists_are_packed_and_sides_dealt_once(spark):
    """Longs of any size come back from their pack; both sides are shuffled once, and only packs are sent to an `a`."""
    most = 2**63 - 1
    given = [[], [7], [1, 2, 65_535], [65_535, 65_536], [-65_537, -1, 0, 1, 10**12], [-most - 1, most], list(range(-5, 70_000, 99))]
    df = spark.createDataFrame([(x,) for x in given], "list array<bigint>")
    got = df.select("list", rules.packed(F.col("list")).alias("pack")).select("list", rules.unpacked(F.col("pack")).alias("back"), (F.size("pack.rest") > 0).alias("wide"))
    assert [(r["list"], r.back) for r in got.collect()] == [(x, x) for x in given]
    assert [bool(r.wide) for r in got.collect()] == [False, False, False, True, True, True, True]
    ends = rules.chain_ends(spark.range(50).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")), spark.range(70).select((F.col("id") % 7).alias("b"), F.col("id").alias("c")))
    plan = ends._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 3 and "Broadcast" not in plan
    assert {(r.a, *sorted(r.ends)) for r in ends.collect()} == {(a, *range(a % 7, 70, 7)) for a in range(50)}


def test_other_shapes_are_joined(spark):
    facts = spark.createDataFrame([("x", "with", "y"), ("x", "in", "z"), ("y", "in", "q")], "s string, p string, o string").withColumn("conf", F.lit(0.9))
    transfer = rules.Rule("t", (("?a", "with", "?b"), ("?a", "in", "?c")), ("?b", "in", "?c"))
    assert rules.conclusions(facts, transfer).collect() == [("y", "in", "z")]
    assert rules.conclusions(facts, rules.Rule("u", (("?a", "with", "?b"),), ("?b", "with", "?a"))).collect() == [("y", "with", "x")]


def test_names_of_components_are_not_broadcast(spark, monkeypatch):
    plans = []
    cut = ontology.cut
    monkeypatch.setattr(ontology, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = [(i, i + 1) for i in range(40) if i % 10 < 9]
    got = {tuple(r) for r in ontology.clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, i // 10 * 10) for i in range(40)}
    assert not any("Broadcast" in p for p in plans)


def test_facts_meet_once_in_the_first_round(spark, monkeypatch):
    """The first round joins a rule's two patterns once, later ones only those whose predicates are new; results are those of the table of rules."""
    plans, cut = [], rules.cut
    monkeypatch.setattr(rules, "cut", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or cut(df))
    some = [r for r in rules.catalogue() if r.name.startswith(("poweredBy", "chargedBy"))]
    told = [("part", "poweredBy", "maker"), ("maker", "chargedBy", "town"), ("town", "chargedBy", "land")]
    facts = spark.createDataFrame(told, "s string, p string, o string").withColumn("conf", F.lit(0.9))
    got = {(r.s, r.p, r.o, r["round"]) for r in rules.propagate(facts, some).collect()}
    assert got == {(*t, 0) for t in told} | {("part", "poweredBy", "town", 1), ("maker", "chargedBy", "land", 1), ("part", "poweredBy", "land", 2)}
    assert [p.count("Join Inner") for p in plans[1:]] == [3, 6, 3][: len(plans) - 1]
