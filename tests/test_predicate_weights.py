"""Facts meet the weights of their predicates without being shuffled by predicate."""

import pytest

from tessera.operators import chains, diagnose
from tessera.streaming import knowledge

FACTS = [(f"entity:a_{i}", "before" if i % 2 else "cause", f"entity:a_{i + 1}", 0.9, i) for i in range(20)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark):
    return spark.createDataFrame(FACTS, "s string, p string, o string, conf double, seq long"), spark.createDataFrame([("before", 0.25), ("cause", 0.5)], "p string, weight double")


@pytest.mark.parametrize("name", ["telemetry_support", "signal_weights", "precursors"])
def test_facts_stay_where_they_are(spark, name):
    got = getattr(diagnose, name)(*frames(spark))
    assert "hashpartitioning(p#" not in plan(got)
    assert got.count() == {"telemetry_support": 21, "signal_weights": 20, "precursors": 20}[name]


def test_scores_of_causes(spark):
    facts, weights = frames(spark)
    got = diagnose.cause_scores(facts.filter("p = 'cause'"), facts, weights, spark.createDataFrame([("cause", 0.1)], "p string, weight double"))
    assert "hashpartitioning(p#" not in plan(got)
    first = {r["cause"]: round(r["score"], 6) for r in got.collect()}
    assert len(first) == 10 and round(first["entity:a_2"] - first["entity:a_0"], 6) == 0.25


def test_index_entries(spark):
    facts, weights = frames(spark)
    got = knowledge.Indexes.rows(facts, weights, spark.createDataFrame([("entity:a_1",)], "id string"))
    assert "hashpartitioning(p#" not in plan(got)
    assert got.groupBy("index").count().orderBy("index").collect() == [("postings", 20), ("signal", 1), ("temporal", 20)]


def test_composed_edges(spark):
    facts, weights = frames(spark)
    side = "struct<s:string,p:string,o:string>"
    rules, types = spark.createDataFrame([], f"ant {side}, con {side}"), spark.createDataFrame([], "id string, type string")
    got = chains.composed_edges(facts, rules, types, weights)
    assert "hashpartitioning(local#" not in plan(got) and got.filter("kind = 'fact'").count() == 20
