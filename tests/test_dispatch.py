"""Dispatches search and count only for the goals that ask for it, and give the same answers."""

from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import chains, diagnose
from tessera.plans import diagnose_queries
from tessera.sources.facts import Tables

SF = "/root/testdata/sf0.001"


def test_only_asked_paths_are_searched(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(chains, "meeting_paths", lambda edges, pairs, depth=6: asked.append(pairs) or pairs.selectExpr("a", "b", "'' AS path", "0 AS hops"))
    t = Tables(spark, SF)
    found = diagnose_queries.lookups(t, diagnose_queries.goals(t))
    assert asked[0].filter("a LIKE 'entity:event%'").isEmpty() and asked[0].count() == 300
    assert found["contrast"].filter("substring(goal, 14)::bigint % 3 <> 0").isEmpty()


def test_relations_begin_no_other_search(spark, monkeypatch):
    """Branches that only the other dispatch has write no rounds."""
    begun = []
    monkeypatch.setattr(chains, "meeting_paths", lambda edges, pairs, depth=6: pairs.selectExpr("a", "b", "'' AS path", "0 AS hops"))
    for name in ("contrasts", "forward_best_path", "rule_ancestry", "condition_contrast", "structured_chain", "backup_lookup"):
        monkeypatch.setattr(diagnose_queries, name, lambda *given, name=name, make=getattr(diagnose_queries, name): begun.append(name) or make(*given))
    diagnose_queries.relation_dispatch(Tables(spark, SF))
    assert begun == []


def test_answers_are_dealt_once(spark):
    """Answers and goals are shuffled once, by goal, and a name's tokens are made once to rate it."""
    rows = spark.range(20).selectExpr("concat('entity:loss_of_system_', id) AS goal", "concat('concept:thing_', id) AS answer")
    got = diagnose.dispatch(rows.selectExpr("goal", "'x' AS cue"), [("x", rows), (None, rows)])
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan
    assert {r.tier for r in got.collect()} == {0} and got.count() == 20
    rated = rows.select(F.round(exprs.specificity(F.col("goal")), 6).alias("a"), F.round(exprs.specificity(F.col("answer")), 6).alias("b"), F.round(exprs.specificity(F.lit(None).cast("string")), 6).alias("c"))
    assert {(r.a, r.b) for r in rated.collect()} == {(0.55, 0.25)}
    assert rated.select("a")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_a_goal_of_two_cues(spark):
    goals = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", None), ("d", "x")], "goal string, cue string")
    branch = lambda *rows: spark.createDataFrame(rows, "goal string, answer string")
    got = diagnose.dispatch(goals, [("x", branch(("b", "no"), ("d", "two"), ("d", "one"))), ("y", branch(("a", "second"))), (None, branch(("a", "last"), ("b", "free"), ("c", "free"), ("e", "none asked")))])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "second", 1), ("b", "free", 2), ("c", "free", 2), ("d", "one", 0)]
