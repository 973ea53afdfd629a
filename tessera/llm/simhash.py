"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 6).

Fingerprints are made in Arrow batches. Every *distinct* fingerprint emits all variants within half
the radius (1 + 64 + 2016 for radius 4); two fingerprints at 4 bits or fewer share a variant, and
fingerprints that share one are 4 bits apart at most, so a shared variant is the verification.

A variant is its upper 32 bits and its lower 32. Rows are shuffled by the upper part, 529 a fingerprint,
each for all variants that share it; the lower parts are made where upper parts meet, so a fingerprint
alone on an upper part costs nothing more. Upper parts on which very many fingerprints meet are counted
first (by a fixed number of hash slots) and dealt by their whole variants instead: one variant has
2,081 owners at most, so no group, however large, is one task's. The rows are proportional to the input
either way. To keep disk bounded they are shuffled in a fixed number of rounds by hash, and a round's
shuffle files are dropped before the next.

A task returns a spanning forest of what met in it, fewer links than fingerprints, never pairs of a
group; connected components of the links are found by large-star/small-star rounds in Spark.

Defined results: null or blank text has fingerprint zero, linked like any other; ids may be null
(their rows stand alone only by id: component_id is the smallest id of the component, null if it has
none) or repeated, each row gives one row; very long texts are hashed piecewise; an empty table gives
none; other columns are ignored. `keep_first` keeps the row with the smallest id of a component (a null
id comes last); among repeated rows of that id the one with the smallest hash of text, then of row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Lower bits of a variant, made at the receiver.
LOW = 32
ROUNDS = 4
#: Rows that a task resolves at a time, whatever the input's size, and variants that it makes at a time.
PARTITION_ROWS = 1_000_000
EXPANDED = 500_000
#: Hash slots that are counted, and rows of a slot from which its variants are dealt whole.
SLOTS = 1 << 16
HOT_ROWS = 100_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * counts[i] > n))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its fp (signed long); other columns stay, one of that name is replaced."""
    out = docs.select(*[c for c in docs.columns if c != "fp"])
    schema = StructType(list(out.schema)).add("fp", "long")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], [*batch.schema.names, "fp"])

    return common.by_batches(out, run, schema)


def masks(radius: int, bits: range = range(BITS)) -> list[int]:
    """All signed 64-bit numbers with at most `radius` of these bits set."""
    made = (sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(bits, r))
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in made]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of the links a - b but the roots: each component's least (unsigned) node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            child = np.flatnonzero(root != np.arange(len(root)))
            return nodes[child], nodes[root[child]]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(rx[apart], ry[apart]), np.minimum(rx[apart], ry[apart]))
        while (root[root] != root).any():
            root = root[root]


def met(z: np.ndarray, own: np.ndarray, spare: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the owners that share a variant; each row is for all variants of z with up to `spare` of its lowest `bits` changed.

    A group of rows too large to be expanded at once is dealt by the next eight bits, and so on.
    """
    links = [(own[:0], own[:0])]
    order = np.argsort(z >> np.uint64(bits), kind="stable")
    key = z[order] >> np.uint64(bits)
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    alone = np.repeat(size == 1, size)
    order, size = order[~alone], size[size > 1]
    if not len(order):
        return links[0]
    z, own, spare = z[order], own[order], spare[order]
    low = [np.array(masks(r, range(bits)), np.int64).view(np.uint64) for r in range(int(spare.max()) + 1)]
    cost = np.add.reduceat(np.array([len(x) for x in low])[spare], np.cumsum(size) - size)
    large = cost > EXPANDED
    block = np.cumsum(np.where(large, EXPANDED, cost)) // EXPANDED + np.cumsum(large) + np.cumsum(np.concatenate(([0], large[:-1])))
    edges = np.flatnonzero(np.diff(block)) + 1
    ends = np.cumsum(size)
    for g, h in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(size)]))):
        i, j = (ends[g - 1] if g else 0), ends[h - 1]
        zs, owns, spares = z[i:j], own[i:j], spare[i:j]
        if large[g] and bits > 8:
            top, rest = np.uint64(bits - 8), (zs >> np.uint64(bits - 8)) & np.uint64(255)
            for value in range(256):
                flips = np.bitwise_count(rest ^ np.uint64(value)).astype(np.int64)
                can = flips <= spares
                if can.sum() > 1:
                    moved = zs[can] ^ ((rest[can] ^ np.uint64(value)) << top)
                    links.append(met(moved, owns[can], spares[can] - flips[can], bits - 8))
            continue
        made = [(zs[spares == r][:, None] ^ low[r][None, :], owns[spares == r]) for r in range(len(low))]
        variant = np.concatenate([m.ravel() for m, _ in made])
        owner = np.concatenate([np.repeat(o, m.shape[1]) for m, o in made])
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        same = (variant[1:] == variant[:-1]) & (owner[1:] != owner[:-1])
        if same.any():
            links.append(forest(owner[1:][same], owner[:-1][same]))
    return forest(*(np.concatenate([x[k] for x in links]) for k in (0, 1)))


def long_array(values: list[int]) -> Column:
    return F.lit(values).cast("array<long>")


def variants(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, m, slot): an upper mask for every upper part of the variants of a fingerprint, and the hash slot of that part."""
    upper = distinct.select("fp", F.explode(long_array(masks(radius // 2, range(LOW, BITS)))).alias("m"))
    h = F.xxhash64(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), LOW))
    return upper.withColumn("slot", F.shiftrightunsigned(h, 8).bitwiseAND(SLOTS - 1))


def hot_slots(every: DataFrame, hot_rows: int) -> list[int]:
    """Slots with more than hot_rows rows and than four times the mean of all slots: a quarter of the slots at most."""
    counted = common.cut(every.groupBy("slot").agg(F.count("*").alias("n")))
    mean = counted.agg(F.sum("n")).first()[0] or 0
    return [r["slot"] for r in counted.filter(F.col("n") > max(hot_rows, 4 * mean // SLOTS)).select("slot").collect()]


def round_links(every: DataFrame, hot: list[int], this: int, rounds: int, parts: int, radius: int) -> DataFrame:
    """(a, b): a forest of links found by one round's variants; b is the smaller, unsigned."""
    half = radius // 2
    here = every.filter(F.pmod("slot", F.lit(rounds)) == this)
    rows = here.filter(~F.col("slot").isin(hot) if hot else F.lit(True)).select("fp", "m", F.lit(False).alias("whole"))
    if hot:
        spare = half - F.bit_count("m")
        lower = F.when(spare == 0, long_array(masks(0)))
        for r in range(1, half + 1):
            lower = lower.when(spare == r, long_array(masks(r, range(LOW))))
        dealt = here.filter(F.col("slot").isin(hot)).select("fp", "m", F.explode(lower).alias("low"))
        rows = rows.unionByName(dealt.select("fp", F.col("m").bitwiseXOR(F.col("low")).alias("m"), F.lit(True).alias("whole")))
    variant = F.col("fp").bitwiseXOR(F.col("m"))
    key = F.when(F.col("whole"), variant).otherwise(F.shiftrightunsigned(variant, LOW))

    def resolve(batches):
        columns = [[], [], []]
        for batch in batches:
            for k, held in enumerate(columns):
                held.append(batch.column(k).to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        fp, m, whole = map(np.concatenate, columns)
        fp, m = fp.view(np.uint64), m.view(np.uint64)
        z, spare = fp ^ m, half - np.bitwise_count(m).astype(np.int64)
        found = [met(z[~whole], fp[~whole], spare[~whole], LOW), met(z[whole], fp[whole], 0 * spare[whole], 0)]
        a, b = forest(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].view(np.int64)) for x in (a, b)], ["a", "b"])

    return rows.repartition(parts, key).mapInArrow(resolve, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct (a, b) that connect all fingerprints within the radius, fewer than a task's fingerprints from each task."""
    spark = fps.sparkSession
    distinct = common.cut(fps.select("fp").filter(F.col("fp").isNotNull()).distinct())
    rows = distinct.count() * len(masks(radius // 2, range(LOW, BITS)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // rounds // PARTITION_ROWS + 1)
    every = variants(common.cut(distinct.repartition(rows // PARTITION_ROWS + 1)), radius)
    found = None
    with common.shuffle_files_dropped(spark):
        hot = hot_slots(every, hot_rows)
        for this in range(rounds):
            made = common.cut(round_links(every, hot, this, rounds, parts, radius))
            found = made if found is None else found.unionByName(made)
        return common.cut(found.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by alternating large-star and small-star.

    Order of nodes is that of signed longs; root is the smallest. Each round is checkpointed; the
    loop ends when a round changes nothing.
    """
    now = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = common.cut(small.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def groups(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of (doc_id, fp).

    root names the component; component_id is its smallest doc_id.
    """
    roots = components(links(fps, radius, rounds)).withColumnRenamed("node", "fp")
    own = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = common.cut(own.groupBy("root").agg(F.min("least").alias("component_id")))
    # Both sides are stored, so Spark can split the rows of the largest component between tasks.
    return common.cut(own.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of (doc_id, text)."""
    fps = common.cut(fingerprints(docs.select("doc_id", "text")).drop("text"))
    return fps.join(groups(fps, radius, rounds), "fp", "left")


def keep_first(docs: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest doc_id (ties: see above)."""
    whole = F.struct(*docs.columns).alias("row")  # so that no column of docs can clash with ours
    marked = common.written(fingerprints(docs.select(whole, "doc_id", "text")).select("row", "doc_id", F.struct(*common.text_key(F.col("text"))).alias("key"), "fp"))
    found = groups(marked.select("doc_id", "fp"), radius, rounds)
    # Candidates are aggregated before they meet their component: a row for each fingerprint, whatever its copies.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key", F.xxhash64("row").alias("h"))
    best = marked.groupBy("fp").agg(F.min(order).alias("first")).join(found.select("fp", "root"), "fp")
    winners = common.cut(best.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("w")).select("w.fp", "w.first.*"))
    hashed, won = marked.withColumn("h", F.xxhash64("row")), winners.select("id", *[F.col(c).alias(f"won_{c}") for c in ("fp", "key", "h")])
    same = [F.col(c) == F.col(f"won_{c}") for c in ("fp", "key", "h")]
    picked = hashed.join(won, [F.col("doc_id").eqNullSafe(F.col("id")), *same])
    return picked.groupBy("fp", "key").agg(F.any_value("row").alias("row")).select("row.*")  # one of rows that are equal


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
