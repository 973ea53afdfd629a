"""Suffix-array dedup of long byte strings (operator 1).

Every byte that lies in a string of `length` bytes (400) which also starts elsewhere is removed.
All suffixes, cut to that length, would be sorted; only those in contested suffix buckets are.

1. Buckets. A suffix belongs to the bucket of the smallest hashed 32-gram of its 400 bytes (the
   leftmost of equal ones). Equal suffixes are in one bucket. Neighbouring suffixes with the same
   32-gram are one *segment*; no two suffixes of a segment are equal.
2. Spark counts buckets and distinct segments. A bucket with one segment has nothing to compare; one
   whose segments are all the same text is removed as a whole. The rest is contested.
3. Contested buckets are built blockwise, one block of whole buckets at a time, so memory is bounded:
   suffixes are sorted by their first and last v bytes, and long ties by precomputed ranks of a
   difference-cover sample (v = 31, 6 residues): of any two suffixes, one offset below v brings both
   to sampled positions, where 248-byte ranks made by prefix doubling decide. Ties are split by a
   three-way quicksort, all groups at once.
4. A bucket too large for a block is dealt into several by a salt, each sorted the same way. Of every
   set of equal suffixes one leaves its block, as a 128-bit digest; Spark counts these over the blocks.
5. Runs of repeated suffixes go back to their texts and are cut out.

Only contested segments and, at the end, the documents themselves are shuffled with their bytes.

`repeated_words` finds passages of more than 50 words that stand elsewhere too, however few bytes they
have, the same way: every word is written as a 32-bit code, and 51 codes are the length. Passages that
differ in a word are taken for equal with a chance of one in 2^32.

Defined results: null text counts as empty; texts below 400 bytes lose nothing; ids may be null or
repeated, each row gives one row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
GRAM = 32
#: Words of a repeated passage (at least), and bytes of a word's code.
PASSAGE_WORDS = 51
CODE = 4
#: Bytes of contested segments that are sorted at a time (they stay in a core's cache), and those of a bucket from which step 4 takes over.
BLOCK_BYTES = 512 << 10
BUCKET_BYTES = 4 << 20
#: Bytes of texts that are hashed at a time.
CHUNK_BYTES = 128 << 10

# A perfect difference set; every residue modulo 31 is a difference of two members.
COVER_PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def cover_offsets() -> np.ndarray:
    """[a, b]: the least d with a + d and b + d both in the cover, modulo the period."""
    v, table = COVER_PERIOD, np.full((COVER_PERIOD, COVER_PERIOD), -1, np.int64)
    for d in range(v - 1, -1, -1):
        hit = [(c - d) % v for c in COVER]
        for a in hit:
            table[a, hit] = d
    assert (table >= 0).all(), "not a difference cover"
    return table


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    h = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text number, bucket, first start in the text, number of starts, 16-byte digest of its bytes)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    if len(joined) < length:
        return
    data = np.frombuffer(joined, np.uint8)
    h = gram_hashes(data)
    low = np.uint64((1 << len(h).bit_length()) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.maximum(sizes - length + 1, 0)
    number = np.repeat(np.arange(len(texts)), counts)
    if not len(number):
        return
    at = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)  # start within its text
    anchor = least[begins[number] + at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]))))
    n = np.diff(np.append(first, len(number)))
    bucket = h[anchor[first].astype(np.int64)].view(np.int64)
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    where = begins[number[first]] + at[first]
    for i, key, start, k, p in zip(number[first].tolist(), bucket.tolist(), at[first].tolist(), n.tolist(), where.tolist()):
        yield i, key, start, k, digest(view[p : p + k + length - 1])


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks, from 0, of the tuples of keys (the first is the most significant)."""
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        changed[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(changed)
    return ranks


def doublings(length: int) -> int:
    """How often ranks can be doubled so that the ranked bytes, from any offset below the period, stay within `length`."""
    return ((length - COVER_PERIOD + 1) // COVER_PERIOD).bit_length() - 1


def sample_ranks(data: np.ndarray, words: np.ndarray, times: int) -> np.ndarray:
    """[position]: rank of the (period << times) bytes from there, for positions in the cover; by prefix doubling."""
    v = COVER_PERIOD
    sampled = np.flatnonzero(np.isin(np.arange(len(data) - v + 1) % v, COVER))
    ranks = np.full(len(data) + (v << times), -1, np.int64)
    ranks[sampled] = dense(*(words[sampled + o] for o in (0, 8, 16, 23)))
    for k in range(times):
        ranks[sampled] = dense(ranks[sampled], ranks[sampled + (v << k)])
    return ranks


def equal_starts(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> np.ndarray:
    """For all starts (counts[i] in pieces[i], one after the other): number of a start with the same `length` bytes, the same for all of these."""
    v, table = COVER_PERIOD, cover_offsets()
    data = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
    begins = np.cumsum([0, *map(len, pieces[:-1])])
    n = np.array(counts)
    owner = np.repeat(np.arange(len(pieces)), n)
    starts = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    words = words_at(data)
    times = doublings(length)
    ranks, ranked = sample_ranks(data, words, times), v << times
    near = length - ranked - (v - 1)  # from here on, a sampled position's ranked bytes end within the prefix
    assert 0 <= near <= ranked - v
    tail = length - v
    group = dense(*(words[starts + o] for o in (0, 8, 16, 23)), *(words[starts + tail + o] for o in (0, 8, 16, 23)))
    found = np.arange(len(starts))
    order = np.argsort(group, kind="stable")
    group = group[order]
    while len(order):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        many = np.repeat(size > 1, size)
        pivot = np.repeat(order[first + size // 2], size)[many]
        order, group = order[many], group[many]
        if not len(order):
            break
        i, p = starts[order], starts[pivot]
        d = table[i % v, p % v]
        e = near + table[(i + near) % v, (p + near) % v]
        side = np.sign(ranks[i + d] - ranks[p + d])
        side = np.where(side == 0, np.sign(ranks[i + e] - ranks[p + e]), side)
        same = side == 0
        others = same & (order != pivot)
        found[order[others]] = pivot[others]
        order, group = order[~same], (2 * group + (side > 0))[~same]
        again = np.argsort(group, kind="stable")
        order = order[again]
        group = np.cumsum(np.concatenate(([0], np.diff(group[again]) != 0))) if len(order) else group
    return found


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def find_segments(docs: DataFrame, length: int) -> DataFrame:
    """(bucket, d1, d2, k1, k2, start, n) of every row (k1, k2, data)."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            rows, held, size, n = [], [], 0, batch.num_rows
            for j, t in enumerate(batch.column(2).to_pylist()):
                held.append(t or b"")
                size += len(held[-1])
                if size >= CHUNK_BYTES or j == n - 1:
                    rows += [(j + 1 - len(held) + i, *r) for i, *r in segments(held, length)]
                    held, size = [], 0
            digests = np.frombuffer(b"".join(r[4] for r in rows), np.int64).reshape(-1, 2)
            i = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.array(k1[i]),
                    pa.array(k2[i]),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                ["bucket", "d1", "d2", "k1", "k2", "start", "n"],
            )

    return common.by_batches(docs.select("k1", "k2", "data"), run, "bucket long, d1 long, d2 long, k1 long, k2 long, start int, n int")


def sort_blocks(contested: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(d1, d2, first, len, a, b): runs of starts repeated in their block, of contested segments (bucket, salt, d1, d2, n, bytes).

    Blocks are of whole buckets, but where the bucket is dealt by a salt. Then one start of every set of
    equal ones follows, a and b being the digest of its `length` bytes.
    """
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        held, size = [], 0

        def solved():
            same = equal_starts([h[4] for h in held], [h[3] for h in held], length)
            often = np.bincount(same, minlength=len(same))
            at, rows = 0, []
            for salt, d1, d2, n, data in held:
                own = same[at : at + n]
                rows += [(d1, d2, a, b, None, None) for a, b in zip(*(x.tolist() for x in runs_of(often[own] > 1)))]
                if salt is not None:
                    for i in np.flatnonzero(own == np.arange(at, at + n)).tolist():
                        rows.append((d1, d2, i, 1, *np.frombuffer(xxhash.xxh3_128_digest(data[i : i + length]), np.int64).tolist()))
                at += n
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["d1", "d2", "first", "len", "a", "b"])

        last = None
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                part = bucket, row[0]
                if size >= block_bytes and part != last:
                    yield solved()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[4])
                last = part
        if held:
            yield solved()

    return common.by_batches(contested.select("bucket", "salt", "d1", "d2", "n", "bytes"), run, "d1 long, d2 long, first int, len int, a long, b long")


def repeated_runs(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k1, k2, runs: array<struct<start, len>>) of every row with repeated starts; docs has k1, k2, data (binary)."""
    spark = docs.sparkSession
    with common.shuffle_files_dropped(spark), common.scratch(spark) as written:
        every = written(find_segments(docs, length))
        shared = written(every.groupBy("bucket").agg(F.count("*").alias("times")).filter("times > 1").select("bucket"))
        kept = written(every.join(shared, "bucket"))
        place = F.struct("k1", "k2", "start", "n")
        distinct = written(kept.groupBy("bucket", "d1", "d2").agg(F.count("*").alias("copies"), F.min(place).alias("at")))
        sizes = distinct.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum(F.col("at.n") + length - 1).alias("size"))
        contested = distinct.join(written(sizes.filter("kinds > 1")), "bucket")
        own = contested.select("bucket", "d1", "d2", "size", "copies", "at.*").groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "d1", "d2", "size", "start", "n")).alias("own"))
        # Of the copies of a text one is cut up.
        once = docs.select("k1", "k2", "data").groupBy("k1", "k2").agg(F.any_value("data").alias("data")).join(own, ["k1", "k2"])
        pieces = once.select("data", F.explode("own").alias("s")).select("s.*", F.expr(f"substring(data, s.start + 1, s.n + {length - 1})").alias("bytes"))
        salts = F.ceil(F.col("size") / bucket_bytes)
        blocks = pieces.withColumn("salt", F.when(salts > 1, F.pmod("d1", salts))).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
        sorted_ = written(sort_blocks(blocks, length, block_bytes))
        alike = sorted_.filter("a IS NOT NULL")
        twice = alike.groupBy("a", "b").agg(F.count("*").alias("times")).filter("times > 1").select("a", "b")
        found = sorted_.filter("a IS NULL").unionByName(alike.join(twice, ["a", "b"])).select("d1", "d2", "first", "len")
        # A segment that occurs twice is repeated as a whole, whatever else its bucket has.
        whole = distinct.filter("copies > 1").select("d1", "d2", F.lit(0).alias("first"), F.col("at.n").alias("len"))
        marked = written(whole.unionByName(found))
        places = kept.join(marked, ["d1", "d2"]).select("k1", "k2", (F.col("start") + F.col("first")).alias("start"), "len").distinct()
        return common.written(places.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs")))


def cut_spans(size: int, runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed (begin, end) of a text of `size` bytes; runs are sorted (start, number of starts)."""
    spans: list[tuple[int, int]] = []
    for start, n in runs:
        end = min(size, start + n + length - 1)
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *common.text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def with_runs(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, runs) of every row of (doc_id, text)."""
    own = keyed(docs)
    data = own.select("k1", "k2", F.col("text").cast("binary").alias("data"))
    return own.join(repeated_runs(data, length, block_bytes, bucket_bytes), ["k1", "k2"], "left").select("doc_id", "text", "runs")


def word_codes(docs: DataFrame) -> DataFrame:
    """(k1, k2, data: the codes of the text's words) of every row of (k1, k2, text)."""

    def run(batches):
        for batch in batches:
            split = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(2).to_pylist()]
            codes = [np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)).tobytes() for words in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["k1", "k2", "data"])

    return common.by_batches(docs.select("k1", "k2", "text"), run, "k1 long, k2 long, data binary")


def repeated_words(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(k1, k2, n_repeated_words) of the texts (k1, k2, text) with passages of at least `words` words that stand elsewhere too."""
    with common.scratch(docs.sparkSession) as written:
        runs = repeated_runs(written(word_codes(docs)), words * CODE)

    def run(batches):
        for batch in batches:
            counts = []
            for found in batch.column(2).to_pylist():
                whole = [(-(-r["start"] // CODE), (r["start"] + r["len"] - 1) // CODE) for r in found]  # first and last word that starts one
                counts.append(sum(b - a for a, b in cut_spans(1 << 60, [(a, b - a + 1) for a, b in whole if a <= b], words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["k1", "k2", "n_repeated_words"])

    return common.by_batches(runs, run, "k1 long, k2 long, n_repeated_words long")


def dedup_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept: binary, spans) of every row of (doc_id, text): what stays, and the byte spans cut out."""

    def run(batches):
        for batch in batches:
            rows = list(_cut(batch, length))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.binary()), pa.array([[{"begin": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "kept", "spans"],
            )

    return common.by_batches(with_runs(docs, length), run, "doc_id long, kept binary, spans array<struct<begin: int, end: int>>")


def _cut(batch, length):
    """(size, kept bytes, spans) of each row (doc_id, text, runs)."""
    for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        data = text.encode("utf-8", "surrogatepass")
        spans = cut_spans(len(data), [(r["start"], r["len"]) for r in runs or ()], length)
        edges = [0, *(x for span in spans for x in span), len(data)]
        yield len(data), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else data, spans


def digests(joined: DataFrame, length: int = LENGTH) -> DataFrame:
    """The contract's columns of (doc_id, text, runs, ...), then the further ones."""
    more = [f for f in joined.schema if f.name not in ("doc_id", "text", "runs")]

    def run(batches):
        for batch in batches:
            rows = [(size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for size, kept, spans in _cut(batch, length)]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[f.name for f in more]])

    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return common.by_batches(joined.select("doc_id", "text", "runs", *[f.name for f in more]), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + types)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keyed(common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    runs = repeated_runs(own.select("k1", "k2", F.col("text").cast("binary").alias("data")))
    found = common.written(runs.join(repeated_words(own), ["k1", "k2"], "full"))
    joined = own.join(found, ["k1", "k2"], "left").withColumn("n_repeated_words", F.coalesce("n_repeated_words", F.lit(0)).cast("long"))
    return digests(joined.select("doc_id", "text", "runs", "n_repeated_words"))
