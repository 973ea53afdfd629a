"""Diagnostic answers against plain versions over random sessions, and planted cases."""

import random

from tessera.operators import answers

FACTS, TARGETS = "goal long, s string, p string, o string, seq long", "goal long, target string, modifier string"


def support(a, b, facts):
    total = 0.0
    for s, p, o in facts:
        if p not in ("before", "after", "during"):
            continue
        if (s, o) == (a, b) or p == "after" and (s, o) == (b, a):
            total += 0.4
        elif p == "before" and (s, o) == (b, a) or p == "during" and s in (a, b):
            total += 0.2
    return total


def made(rng, goals=25):
    names = ["entity:pump", "entity:main_pump", "entity:loss_of_pump", "entity:pump_system", "entity:bus_a", "entity:bus_b"]
    facts, targets, kinds = [], [], []
    for goal in range(goals):
        own = {(rng.choice(names), rng.choice(["before", "after", "during", "cause"]), rng.choice(names)) for _ in range(rng.randrange(9))}
        facts += [(goal, s, p, o, i) for i, (s, p, o) in enumerate(sorted(own))]
        targets.append((goal, rng.choice(names), rng.choice([None, "Sequence please", "other"])))
        kinds += [(goal, kind, n) for n in names for kind in (answers.COMPONENT, answers.PRECURSOR, answers.EVIDENCE) if rng.random() < 0.4]
    return facts, targets, kinds


def test_alignment_against_pairs(spark):
    facts, targets, kinds = made(random.Random(4))
    table = spark.createDataFrame
    found = table(kinds, "goal long, kind string, node string")
    failures = answers.of_kind(found, answers.COMPONENT)
    got = {(r.goal, r.node): r.score for r in answers.alignment(failures, found, table(targets, TARGETS), table(facts, FACTS)).collect()}
    expected = {}
    for goal, target, modifier in targets:
        own = [(s, p, o) for g, s, p, o, _ in facts if g == goal]
        of = lambda kind: [n for g, k, n in kinds if g == goal and k == kind]  # noqa: B023, E731
        for node in of(answers.COMPONENT):
            score = sum(0.6 * support(a, node, own) + 0.4 * support(a, target, own) for a in of(answers.PRECURSOR)) + sum(0.4 * support(a, node, own) + 0.2 * support(a, target, own) for a in of(answers.EVIDENCE))
            expected[goal, node] = round(score + (0.2 if modifier and "equence" in modifier else 0.0), 6)
    assert got == expected and len({v for v in got.values()}) > 10


def test_top_equals_plain_order(spark):
    rows = [(g, f"n{i % 90}") for g, n in ((0, 400), (1, 3), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "goal long, node string").distinct()
    from pyspark.sql import functions as F

    got = sorted((r.goal, r.place, r.node) for r in answers.top(df, ["goal"], [F.col("node")], F.col("node"), 5).collect())
    assert got == sorted((g, i + 1, n) for g in range(3) for i, n in enumerate(sorted({n for h, n in rows if h == g})[:5]))


def test_evidence_is_not_paired(spark):
    """A goal with n signals and n failures makes rows in proportion to n, not to its square."""
    from pyspark.sql import functions as F

    n = 3000
    ids = spark.range(n)
    sources = ids.select(F.lit(1).cast("long").alias("goal"), F.concat(F.lit("s"), "id").alias("node"))
    nodes = ids.select(F.lit(1).cast("long").alias("goal"), F.concat(F.lit("f"), "id").alias("node"))
    facts = ids.select(F.lit(1).cast("long").alias("goal"), F.concat(F.lit("s"), "id").alias("s"), F.lit("during").alias("p"), F.concat(F.lit("f"), "id").alias("o"), "id")
    got = answers.supported(nodes, sources, facts.withColumnRenamed("id", "seq")).collect()
    # its own signal gives 0.4, each other one 0.2 by its `during` fact
    assert len(got) == n and {r.support for r in got} == {round(0.4 + 0.2 * (n - 1), 6)}


def test_planted_cases(spark):
    table = spark.createDataFrame
    facts = table(
        [(1, "entity:valve", "fail", "concept:true", 1), (1, "entity:vibration", "before", "entity:shutdown", 2), (1, "entity:pump", "operate", "concept:false", 3), (1, "entity:shutdown", "control", "concept:false", 4),
         (1, "entity:backup_unit", "During", "entity:restart", 5), (1, "entity:light", "after", "entity:restart", 6), (1, "entity:valve", "before", "entity:shutdown", 7), (2, "entity:crew", "http://x/onto#regain", "entity:grid", 1)], FACTS,
    )
    rules = table([(1, ("entity:valve", "fail", "concept:true"), ("entity:line", "fail", "concept:true")), (1, ("entity:x", "work", "concept:false"), ("entity:y", "control", "concept:false"))], "goal long, ant struct<s string, p string, o string>, con struct<s string, p string, o string>")
    targets = table([(1, "entity:shutdown", "the recovery"), (2, "entity:grid", None)], TARGETS)
    roles = table([("entity:restart", "x; recovery_phase"), ("entity:light", "evidence_signal"), ("entity:grid", "control_target")], "id string, role string")
    weights = table([("before", 0.3), ("after", 0.0)], "p string, weight double")
    found = answers.candidates(facts, rules, targets, roles, weights).cache()
    kinds = {}
    for r in found.collect():
        kinds.setdefault(r.kind, set()).add(r.node.split(":")[1])
    assert kinds == {"component": {"valve", "pump"}, "subsystem": {"valve", "pump", "line"}, "loss": {"shutdown", "y"}, "precursor": {"vibration", "valve"}, "evidence": {"vibration", "valve"}, "agent": {"backup_unit"}}
    chains = {r.goal: r.lines for r in answers.structured_chains(found, targets, facts, roles).collect()}
    assert chains[2] == ["Outcome: loss of grid."]
    assert chains[1] == [
        "Precursor signal was valve.", "The pump failed.", "This caused the valve to fail.", "This caused the line to fail.", "The shutdown does not control.", "Outcome: shutdown.",
        "Recovery: backup unit was active during recovery.", "The valve before shutdown.",
    ]
    outcomes = answers.outcome_targets(targets, answers.primary_outcomes(facts, roles), roles)
    assert {(r.goal, r.node, r.tier) for r in answers.restorers(found, outcomes, facts).collect()} == {(1, "entity:backup_unit", 0), (2, "entity:crew", 1)}


def test_empty_and_null(spark):
    table = spark.createDataFrame
    facts, targets = table([], FACTS), table([(1, None, None)], TARGETS)
    rules = table([], "goal long, ant struct<s string, p string, o string>, con struct<s string, p string, o string>")
    roles, weights = table([(None, None)], "id string, role string"), table([], "p string, weight double")
    found = answers.candidates(facts, rules, targets, roles, weights)
    assert found.count() == 0 and answers.aligned_failure(found, targets, facts).count() == 0
    assert answers.ruled_out(found, targets, facts).count() == 0
    assert answers.condition_contrasts(table([], "goal long, place int, symbol string"), table([], "goal long, place int, resource string, status int"), facts).count() == 0
