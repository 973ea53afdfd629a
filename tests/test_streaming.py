"""Streams in several batches against the rules of insertion, recorded rules and memory."""

import tempfile

import pytest

from tessera.operators import rules
from tessera.streaming import ingest


@pytest.fixture
def batches(spark):
    """Writes lists of rows as files, of which each batch reads one in the order they were written."""

    def write(rows, schema):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"
        for own in rows:
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)
        return ingest.stream_table(spark, folder, files_per_batch=1)

    return write


FACT = "s string, p string, o string, conf double, seq long"


def test_facts_keep_the_first_confidence_over_batches(batches):
    stream = batches([[("a", "p", "b", 0.5, 2), ("a", "p", "b", 0.4, 1), ("c", "p", "d", 0.1, 3)], [("a", "p", "b", 0.9, 9), ("e", "p", "f", 0.3, 4), (None, "p", "f", 0.3, 5)], [(None, "p", "f", 0.8, 6)]], FACT)
    got = sorted(map(tuple, ingest.ingest_facts(stream).collect()), key=str)
    assert got == sorted([("a", "p", "b", 0.4, 1), ("c", "p", "d", 0.1, 3), ("e", "p", "f", 0.3, 4), (None, "p", "f", 0.3, 5)], key=str)


def test_recorded_rules_apply_to_later_facts(spark, batches):
    rule = "p string, o string, p2 string, o2 string, weight double"
    recorded = ingest.ingest_rules(batches([[("is", "cat", "is", "animal", 0.7)], [("is", "cat", "is", "animal", 0.7), ("is", "animal", "is", "alive", 0.6)]], rule), ["p", "o", "p2", "o2"])
    assert recorded.count() == 2
    stream = batches([[("tom", "is", "cat", 1.0, 1)], [("rex", "is", "animal", 1.0, 2), ("tom", "is", "alive", 1.0, 3)]], FACT)
    got = {tuple(r)[:4] for r in ingest.ingest_facts(stream, keep=lambda new: rules.close_kinds(new, recorded)).collect()}
    assert got == {("tom", "is", "cat", 1.0), ("tom", "is", "animal", 0.7), ("tom", "is", "alive", 1.0), ("rex", "is", "animal", 1.0), ("rex", "is", "alive", 0.6)}


def test_counts_over_batches(batches):
    stream = batches([[("x",), ("x",), ("y",)], [("x",), (None,)]], "k string")
    assert {tuple(r) for r in ingest.index_counts(stream, ["k"]).collect()} == {("x", 3), ("y", 1), (None, 1)}


def test_memory_holds_distinct_texts(batches):
    stream = batches([[(1, 1, "a"), (1, 2, "b"), (2, 1, None)], [(1, 3, "a"), (1, 4, "c"), (1, 5, None)]], "conv_id long, turn int, text string")
    assert {tuple(r) for r in ingest.session_memory(stream, keep=2).collect()} == {(1, 2, 5), (2, 0, 1)}
