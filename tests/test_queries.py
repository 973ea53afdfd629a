"""Every query of the knowledge-graph part against its DuckDB equivalent, at the smallest scale."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    return "NULL" if value is None else value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    oracle = duck.sql(ORACLES[name])
    assert sorted(oracle.columns) == columns
    order = [oracle.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in order) for r in oracle.fetchall())
    assert got
