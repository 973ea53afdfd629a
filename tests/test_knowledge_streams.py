"""Session memory, knowledge and indexes over streams in many batches and orders, against plain versions."""

import datetime
import random
import tempfile
from collections import defaultdict
from pathlib import Path

import pytest

from tessera.streaming import ingest, knowledge, session

START = datetime.datetime(2024, 1, 1)
RULE = "p string, o string, p2 string, o2 string, weight double"


@pytest.fixture
def arrivals(spark):
    """put(rows, schema) adds a file; stream() reads files one a batch in the order they came."""

    class Table:
        def __init__(self):
            self.folder, self.schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table", None

        def put(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.folder)
            self.schema = schema

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    return Table


def session_rows(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        kind = rng.choice(["entity"] * 4 + ["fact"] * 2 + ["answer"] * 2 + ["reset"] * (i % 40 == 0))
        minutes = rng.choice([i, i + 1, i * 3])
        rows.append((rng.choice("abc"), kind, rng.choice(["q1", "q2", None]), rng.choice([f"v{rng.randint(0, 30)}"] * 9 + [None, " "]), START + datetime.timedelta(minutes=minutes), i))
    return [*rows, (None, "entity", None, "x", START, 1), ("d", "other", None, "x", START, 1), ("d", "entity", None, "old", START, 0)]


def plain_session(rows, idle, sizes, late):
    out, end = [], max(r[4] for r in rows)
    for name in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == name and r[1] in session.KINDS and (r[1] == "reset" or (r[3] or "").strip())]
        newest = max((r[4] for r in own), default=None)
        if newest is None or newest + idle < end - late:
            continue
        reset = max([(r[4], r[5]) for r in own if r[1] == "reset"], default=None)
        lists = defaultdict(list)
        for r in sorted(own, key=lambda r: (r[4], r[5]), reverse=True):
            if r[1] != "reset" and (reset is None or (r[4], r[5]) > reset) and r[4] >= newest - idle:
                held = lists[r[1], (r[2] or "") if r[1] == "answer" else ""]
                if (r[1] == "fact" or r[3] not in [x[3] for x in held]) and len(held) < sizes[r[1]]:
                    held.append(r)
        out += [(name, kind, key, r[3], r[4], r[5], k + 1) for (kind, key), held in lists.items() for k, r in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("batches,late", [(1, 3 * 1440), (6, 3 * 1440), (2, 600)])
def test_session_memory_in_any_order(arrivals, monkeypatch, batches, late):
    """Rows come in random order; resets, evictions and items older than `idle` go; idle sessions expire beyond the watermark."""
    monkeypatch.setattr(ingest, "FOLDED_BATCHES", 3)
    rows, table = session_rows(500), arrivals()
    order = rows[:] if late == 600 else random.Random(1).sample(rows, len(rows))
    if late == 600:  # nothing may come later than the watermark: sorted by time
        order.sort(key=lambda r: r[4])
    for k in range(batches):
        table.put(order[k * len(order) // batches : (k + 1) * len(order) // batches], session.INPUT)
    sizes = {"entity": 10, "fact": 5, "answer": 3}
    got = session.remember(table.stream(), 20_000, f"{late} minutes", entities=10, facts=5, answers=3)
    expected = plain_session(rows, datetime.timedelta(seconds=20_000), sizes, datetime.timedelta(minutes=late))
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert any(r[0] == "d" for r in expected) == (late != 600)


def test_session_goes_on_in_its_folder(spark, arrivals):
    """A second call takes only what is new; a reset between the two forgets what came before it."""
    table, folder = arrivals(), ingest.shared_folder(spark, "session")
    row = lambda k, kind, value: ("s", kind, None, value, START + datetime.timedelta(minutes=k), k)
    table.put([row(1, "entity", "a"), row(2, "entity", "b"), row(3, "entity", "a")], session.INPUT)
    held = lambda: [r.value for r in session.remember(table.stream(), 10**6, "1 day", folder=folder).orderBy("place").collect()]
    assert held() == ["a", "b"]
    table.put([row(4, "reset", None), row(5, "entity", "c")], session.INPUT)
    assert held() == ["c"]
    table.put([row(2, "entity", "late"), row(6, "entity", "b")], session.INPUT)
    assert held() == ["b", "c"]


def test_a_long_session_sends_a_lists_length():
    """What a batch of one session sends on doesn't grow with its rows."""
    import pandas as pd

    sizes = {"entity": 100, "fact": 50, "answer": 50, "reset": 1}
    for n in (1_000, 10_000):
        rows = pd.DataFrame({"session": "s", "kind": ["entity", "fact"] * (n // 2), "key": "", "value": [f"v{k}" for k in range(n)], "ts": range(n), "seq": range(n)})
        assert len(session.cut_to_recent(rows, sizes)) == 150


def test_a_session_is_one_row_of_lists():
    """A session's rows come to its state as one row, which reads no list of a new session; the tie of two answers goes to the name."""
    import json

    import pandas as pd

    sizes = {"entity": 3, "fact": 2, "answer": 1, "reset": 1}
    rows = pd.DataFrame([(s, kind, "", f"{kind}{k % 7}", 10 * k, k) for k in range(300) for s in "ab" for kind in ("entity", "fact")] + [("a", "answer", "q", v, 5_000, 1) for v in "yx"] + [("b", "reset", "", None, 2_975, 0)], columns=["session", "kind", "key", "value", "ts", "seq"])
    got = pd.concat(session.packed(iter([rows[:400], rows[400:]]), sizes))
    assert sorted(got["session"]) == ["a", "b"] and got["ts"].max() == 5_000
    assert {len(json.loads(x)) for x in got["items"]} == {6}

    class Handle:
        def __init__(self):
            self.reads, self.values, self.timers = 0, {}, []
            self.registerTimer = self.timers.append
            self.updateValue = self.values.__setitem__

        def getValueState(self, name, schema):
            return type("Clock", (), {"get": lambda _: None, "update": lambda _, value: None})()

        def getMapState(self, name, key, value):
            return self

        def getValue(self, key):
            self.reads += 1

    for name, expected in (("a", [("answer", "x", 5_000), ("entity", "entity3", 2_970), ("entity", "entity4", 2_980), ("entity", "entity5", 2_990), ("fact", "fact4", 2_980), ("fact", "fact5", 2_990)]), ("b", [("entity", "entity4", 2_980), ("entity", "entity5", 2_990), ("fact", "fact4", 2_980), ("fact", "fact5", 2_990)])):
        handle, memory = Handle(), session.Memory(sizes, 10**6)
        memory.init(handle)
        pack = [{"items": x} for x in got.loc[got["session"] == name, "items"]]
        out = [(r.kind, r.value, r.ts) for r in memory.handleInputRows((name,), iter(pack), None)]
        assert sorted(out[1:]) == expected and out[0][0] == "clock" and handle.reads == 0 and len(handle.timers) == 1


FACTS = [("tom", "is", "cat", 1.0, 1), ("rex", "is", "animal", 0.9, 2), ("tom", "is", "alive", 0.8, 3), ("tom", "is", "cat", 0.5, 0)]
RULES = [("is", "cat", "is", "animal", 0.7), ("is", "animal", "is", "alive", 0.6), ("is", "alive", "has", "heart", 0.5), ("has", "heart", "is", "animal", 0.4), ("is", "cat", "is", "animal", 0.3)]
FOLLOWS = {("tom", "is", "cat", 0.5), ("tom", "is", "animal", 0.7), ("tom", "is", "alive", 0.8), ("tom", "has", "heart", 0.5), ("rex", "is", "animal", 0.9), ("rex", "is", "alive", 0.6), ("rex", "has", "heart", 0.5)}


@pytest.mark.parametrize("order", ["facts first", "rules first", 1, 2])
def test_knowledge_in_any_order(spark, arrivals, order):
    facts, rules, store = arrivals(), arrivals(), knowledge.Knowledge(spark)
    facts.put([], knowledge.TOLD)
    rules.put([], RULE)
    steps = [(facts, r, knowledge.TOLD) for r in FACTS] + [(rules, r, RULE) for r in RULES]
    if order == "rules first":
        steps = steps[len(FACTS) :] + steps[: len(FACTS)]
    elif order != "facts first":
        random.Random(order).shuffle(steps)
    for begin in range(0, len(steps), 5):
        for table, row, schema in steps[begin : begin + 5]:
            table.put([row], schema)
        got = store.take(facts.stream(), rules.stream())
    assert {(r.s, r.p, r.o, r.conf) for r in got.collect()} == FOLLOWS
    # Facts are read as told and as known, rules once, each derivation once: nothing is read again.
    derivations = sum((p, o) == r[:2] for s, p, o, _ in FOLLOWS for r in {(*r[:4],): r for r in RULES}.values()) + sum(1 for s, p, o, _ in FOLLOWS if (p, o) == ("is", "cat"))
    assert store.rows_read == 2 * len(FACTS) + len(RULES) + derivations


def test_facts_of_one_object_are_dealt_over_parts(spark, arrivals, monkeypatch):
    """Facts that share (p, o) aren't all joined in one task, and each still meets each rule once."""
    seen, run = [], ingest.run_available
    monkeypatch.setattr(ingest, "run_available", lambda stream, *rest: seen.append(stream._jdf.queryExecution().analyzed().toString()) or run(stream, *rest))
    facts, rules = arrivals(), arrivals()
    facts.put([(f"s{k}", "is", "cat", 1.0, k) for k in range(100)], knowledge.TOLD)
    rules.put([("is", "cat", "is", "animal", 0.7), ("is", "animal", "is", "alive", 0.6)], RULE)
    got = knowledge.Knowledge(spark).take(facts.stream(), rules.stream())
    assert got.groupBy("o").count().orderBy("o").collect() == [("alive", 100), ("animal", 100), ("cat", 100)]
    assert all("part#" in next(x for x in plan.splitlines() if "Join Inner" in x) for plan in seen)


def test_a_call_is_one_query_with_few_stores(spark, arrivals, monkeypatch):
    """However many partitions the session has and rounds there are: every batch commits every store of the state."""
    calls, run = [], ingest.run_available
    monkeypatch.setattr(ingest, "run_available", lambda *given: calls.append(1) or run(*given))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    facts, rules, store = arrivals(), arrivals(), knowledge.Knowledge(spark)
    facts.put(FACTS, knowledge.TOLD)
    rules.put(RULES, RULE)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = store.take(facts.stream(), rules.stream())
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24" and spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "2"
        assert {(r.s, r.p, r.o, r.conf) for r in got.collect()} == FOLLOWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    operators = [[p for p in Path(o).iterdir() if p.name.isdigit()] for o in Path(f"{store.folder}/offsets/state".removeprefix("file:")).iterdir()]
    assert len(calls) == 1 and [len(x) for x in operators] == [max(knowledge.LEAST, spark.sparkContext.defaultParallelism)] * 3
    assert not [p for x in operators for each in x for p in each.iterdir() if p.name.startswith(("left-", "right-"))]


def plain_indexes(facts, weights, signals):
    found = defaultdict(lambda: [0.0, 0])

    def add(*entry, value=1.0):
        found[entry][0] = max(found[entry][0], value)
        found[entry][1] += 1

    for s, p, o in facts:
        local = p.split("#")[-1].split("/")[-1].split(":")[-1].lower()
        add("postings", local, f"{s} {p} {o}")
        if local in ("poweredby", "require", "requires"):
            add("dependents", o, s)
        if local in ("before", "after", "during"):
            add("temporal", s, "")
            add("temporal", o, "")
        if s in signals and weights.get(p, 0) > 0:
            add("signal", s, "", value=weights[p])
    return {k: tuple(v) for k, v in found.items()}


def test_indexes_after_every_batch(spark, arrivals, monkeypatch):
    """Each index equals the batch version over all rows so far, after each of seven batches, across folding."""
    monkeypatch.setattr(ingest, "FOLDED_BATCHES", 2)
    rng, table, store = random.Random(4), arrivals(), knowledge.Indexes(spark)
    predicates = ["http://x.org/a#requires", "poweredBy", "before", "after", "indicates", "reports", "unknown"]
    weights, signals = {"indicates": 0.8, "reports": 0.4, "unknown": 0.0}, {"n1", "n2"}
    given = spark.createDataFrame(list(weights.items()), "p string, weight double"), spark.createDataFrame([(x,) for x in signals], "id string")
    so_far = []
    for _ in range(7):
        rows = [(f"n{rng.randint(0, 4)}", rng.choice(predicates), f"n{rng.randint(0, 4)}") for _ in range(12)]
        so_far += rows
        table.put(rows, "s string, p string, o string")
        got = store.take(table.stream(), *given)
        assert {(r["index"], r.key, r.member): (r.value, r.n) for r in got.collect()} == plain_indexes(so_far, weights, signals)
    assert len(ingest.children(spark, f"{store.folder}/rows")) + len(ingest.children(spark, f"{store.folder}/folded")) <= 3


def test_later_labels_replace_tokens(spark, arrivals):
    table, store = arrivals(), knowledge.LabelIndex(spark)
    table.put([("a", "Old Ring", 1), ("b", "ring", 2)], "id string, label string, seq long")
    assert {tuple(r) for r in store.take(table.stream()).collect()} == {("old", "a"), ("ring", "a"), ("ring", "b")}
    table.put([("a", "New name", 3), ("b", "earlier", 1)], "id string, label string, seq long")
    assert {tuple(r) for r in store.take(table.stream()).collect()} == {("new", "a"), ("name", "a"), ("ring", "b")}
