import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["goal_id", "answer", "score", "prob", "rank", "evidence"] and df.count() > 0


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))
    if entry.llm is not None:
        assert {"pipeline", *(n for n in queries if n.startswith("op"))} <= set(queries) and sum(n.startswith("op") for n in queries) == 13
    else:
        assert not any(n.startswith("op") or n == "pipeline" for n in queries)
