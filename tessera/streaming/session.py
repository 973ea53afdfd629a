"""Session memory as keyed state of a stream: recent entities, facts and answers, resets, expiry.

A session holds the `entities` it touched last, its last `facts` with repeats, and per question the distinct
`answers` given last. What is recent is decided by (ts, seq) of the rows and not by their arrival, so lists merge
in any order: batches and partitions may come as they like. A reset forgets what is not after it; an item
is forgotten when the session's newest row is more than `idle` later. Once the stream's watermark is `idle` past a
session's newest row a timer drops its state.

State is bounded per list, whatever the session's length. Before the shuffle each Arrow batch is cut to
what could be held, so a session with a third of all rows sends a list's length per batch. After it a session's rows are cut
again and packed into one row, so that the state, which costs Python time a row and a list, is given lists and not events.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from . import ingest

#: Longest lists. Fixed values.
ENTITIES, FACTS, ANSWERS = 100, 50, 50
KINDS = ("entity", "fact", "answer", "reset")
#: Rows that a session emits: the items of the lists it touched, and one row of kind "clock" with its reset and end.
ROW = "session string, kind string, key string, value string, ts long, seq long, reset_ts long, reset_seq long, expired boolean"
INPUT = "session string, kind string, key string, value string, ts timestamp, seq long"
RECENT = INPUT.replace("timestamp", "long")
PACK = "session string, ts long, items string"
#: Rows that a task packs at once.
PACKED = 200_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut_to_recent(rows: pd.DataFrame, sizes: dict[str, int]) -> pd.DataFrame:
    """Of rows (session, kind, key, value, ts, seq) those that a list of its size could hold, newest first, equal ones by value.

    Entities and answers are distinct by value, facts are not; of resets the last one counts.
    """
    rows = rows.sort_values(["ts", "seq", "value"], ascending=[False, False, True], kind="stable")
    repeats = rows.duplicated(["session", "kind", "key", "value"]) & rows["kind"].isin(("entity", "answer"))
    rows = rows[~repeats]
    place = rows.groupby(["session", "kind", "key"], dropna=False, sort=False).cumcount()
    return rows[place < rows["kind"].map(sizes)]


def newest_first(items: Iterable[tuple], size: int, distinct: bool) -> list[tuple]:
    """Of items (-ts, -seq, value) the `size` newest, distinct by value if asked; the same item again is none."""
    found, seen = [], set()
    for item in sorted(items):
        mark = item[2] if distinct else item
        if mark not in seen:
            seen.add(mark)
            found.append(item)
            if len(found) == size:
                break
    return found


def packed(parts: Iterable[pd.DataFrame], sizes: dict[str, int]) -> Iterator[pd.DataFrame]:
    """(session, ts, items) of rows (session, kind, key, value, ts, seq): what each session could hold of PACKED rows or a part more, as one row.

    `items` is a JSON list of [kind, key, value, ts, seq], `ts` its newest.
    """
    own: list[pd.DataFrame] = []

    def pack() -> pd.DataFrame:
        rows, found = cut_to_recent(pd.concat(own), sizes), {}
        for name, *item in rows[["session", "kind", "key", "value", "ts", "seq"]].itertuples(index=False, name=None):
            found.setdefault(name, []).append(item)
        own.clear()
        return pd.DataFrame({"session": list(found), "ts": [max(x[3] for x in items) for items in found.values()], "items": [json.dumps(items) for items in found.values()]})

    for part in parts:
        own.append(part)
        if sum(map(len, own)) >= PACKED:
            yield pack()
    if any(map(len, own)):
        yield pack()


class Memory(StatefulProcessor):
    """Lists of one session, which come in packs: there are many short sessions, and a data frame, or a row an item, would cost more than the lists. Times are microseconds."""

    def __init__(self, sizes: dict[str, int], idle: int):
        self.sizes, self.idle = sizes, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest long, reset_ts long, reset_seq long")
        # A list per kind and, for answers, question.
        self.lists = handle.getMapState("lists", "kind string, key string", "value array<string>, ts array<long>, seq array<long>")

    def first(self, kind: str, items: Iterable[tuple]) -> list[tuple]:
        return newest_first(items, self.sizes[kind], kind != "fact")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had, reset_ts, reset_seq = self.clock.get() or (None, None, None)
        newest, reset = had, None if reset_ts is None else (reset_ts, reset_seq)
        touched: dict[tuple, list[tuple]] = {}
        for kind, name, value, at, seq in (item for row in rows for item in json.loads(row["items"])):
            newest = at if newest is None else max(newest, at)
            if kind == "reset":
                reset = (at, seq) if reset is None else max(reset, (at, seq))
                continue
            own = touched.setdefault((kind, name), [])
            own.append((-at, -seq, value))
            if len(own) > 4 * self.sizes[kind]:  # never many more than the list holds
                own[:] = self.first(kind, own)
        self.clock.update((newest, *(reset or (None, None))))
        if had != newest:
            if had is not None:
                self.handle.deleteTimer((had + self.idle) // 1000 + 1)
            self.handle.registerTimer((newest + self.idle) // 1000 + 1)

        yield self.row(key, "clock", "", None, newest, None, reset, False)
        for (kind, name), own in touched.items():
            held = None if had is None else self.lists.getValue((kind, name))
            if held is not None:
                own += [(-at, -seq, value) for value, at, seq in zip(*held)]
            fresh = [x for x in own if -x[0] >= newest - self.idle and (reset is None or (-x[0], -x[1]) > reset)]
            kept = [(value, -at, -seq) for at, seq, value in self.first(kind, fresh)]
            if kept:
                self.lists.updateValue((kind, name), tuple([x[k] for x in kept] for k in range(3)))
            elif held is not None:
                self.lists.removeKey((kind, name))
            for value, at, seq in kept:
                yield self.row(key, kind, name, value, at, seq, reset, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest, reset_ts, reset_seq = self.clock.get()
        self.clock.clear()
        self.lists.clear()
        yield self.row(key, "clock", "", None, newest, None, None if reset_ts is None else (reset_ts, reset_seq), True)

    @staticmethod
    def row(key, kind: str, name: str, value: str | None, ts: int, seq: int | None, reset: tuple | None, expired: bool) -> Row:
        reset_ts, reset_seq = reset or (None, None)
        return Row(session=key[0], kind=kind, key=name, value=value, ts=ts, seq=seq, reset_ts=reset_ts, reset_seq=reset_seq, expired=expired)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State that may be larger than memory; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remember(
    rows: DataFrame, idle: int, late: str, folder: str | None = None, entities: int = ENTITIES, facts: int = FACTS, answers: int = ANSWERS
) -> DataFrame:
    """What the sessions of a stream hold at its end: session, kind, key, value, ts, seq, place (1 is the newest).

    `rows` has INPUT's columns: kind is one of KINDS, key names the question of an answer, seq decides within one ts.
    Rows without session, ts, or kind, and entities, facts or answers without a value or of blanks only, are none.
    `idle` is in seconds, `late` is the watermark's delay: rows later than that are dropped by Spark, if none of their pack is newer, and sessions
    silent for `idle` beyond it are forgotten. With the `folder` of an earlier call the stream goes on.
    """
    spark = rows.sparkSession
    folder = folder or ingest.shared_folder(spark, "session")
    sizes = {"entity": entities, "fact": facts, "answer": answers, "reset": 1}
    sound = F.col("kind").isin(*KINDS) & F.col("session").isNotNull() & F.col("ts").isNotNull() & ((F.col("kind") == "reset") | (F.trim("value") != ""))
    key = F.when(F.col("kind") == "answer", F.coalesce("key", F.lit(""))).otherwise(F.lit(""))
    rows = rows.filter(sound).select(F.col("session").cast("string").alias("session"), "kind", key.alias("key"), F.when(F.col("kind") != "reset", F.col("value")).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    recent = rows.mapInPandas(lambda parts: (cut_to_recent(part, sizes) for part in parts), RECENT)
    packs = recent.repartition("session").mapInPandas(lambda parts: packed(parts, sizes), PACK)
    timed = packs.withColumn("ts", F.timestamp_micros("ts")).withWatermark("ts", late)
    memory = timed.groupBy("session").transformWithState(Memory(sizes, idle * 1_000_000), outputStructType=ROW, outputMode="Update", timeMode="EventTime")
    # A session's lists and its clock are versions of their own.
    versions = ingest.Versions(spark, folder, StructType.fromDDL(ROW), ["session", "kind", "key"])
    with rocks(spark):
        ingest.run_available(memory, folder, versions.write, mode="update")
    return held(versions.newest(), idle)


def held(newest: DataFrame, idle: int) -> DataFrame:
    """The items of the newest lists that their session's clock has not made forgotten since they were written."""
    clock = newest.filter("kind = 'clock' AND NOT expired").select("session", F.col("ts").alias("newest"), F.col("reset_ts").alias("r_ts"), F.col("reset_seq").alias("r_seq"))
    items = newest.filter("kind <> 'clock'").select("session", "kind", "key", "value", "ts", "seq").join(clock, "session")
    after = F.col("r_ts").isNull() | (F.struct("ts", "seq") > F.struct(F.col("r_ts").alias("ts"), F.col("r_seq").alias("seq")))
    kept = items.filter(after & (F.col("ts") >= F.col("newest") - idle * 1_000_000))
    order = Window.partitionBy("session", "kind", "key").orderBy(F.desc("ts"), F.desc("seq"), "value")
    return kept.withColumn("place", F.row_number().over(order)).select("session", "kind", "key", "value", F.timestamp_micros("ts").alias("ts"), "seq", "place")
