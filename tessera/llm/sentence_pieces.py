"""SentencePiece encoding and decoding with byte spans of the original text (operator 11).

A text is normalised by longest prefixes of the model's compiled character map, a double-array trie
over UTF-8 bytes; every normal character remembers the byte of the original at which its prefix
begins. Pairs of neighbouring symbols whose concatenation is a piece are merged, best score first,
leftmost first among equals. Piece lengths, summed up and looked up in that alignment, are the byte
spans of the original text: an unknown character's byte pieces span nothing but for the last, and of
several pieces made from one prefix the last has all of it.

The normal text is cut where no piece of the vocabulary can reach across: between two characters that
stand next to each other in no piece. Every merge is local to such a chunk, so chunks are encoded on
their own, and a worker keeps the newest ones in a bounded table.

Spark deals out the rows. Defined results: null text counts as empty, which has the begin and end ids
only; ids may be null or repeated, each row gives one row; very long texts are a batch of their own,
and cost memory in proportion to their length; empty tables give none; other columns stay or, in
`digests`, are ignored. Models other than BPE, or with pieces that the user defined or that are
unused, raise a ValueError on the driver.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from . import common

#: Chunks that one worker remembers, twice: the newest and those before.
REMEMBERED_CHUNKS = 150_000
#: Chunks up to this many characters are merged many at once, and so many of them.
SHORT = 32
ROWS_AT_ONCE = 8_000
#: Above every rank; a character that is in no piece; no symbol.
NONE, STRANGE, PAD = 1 << 60, -1, -2
SPACE = "▁"
#: Kinds of pieces and the number of the BPE model type in the model file's format. Fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields; a value is an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            at += size
            yield number, data[at - size : at]


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie and the replacements it points at."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]
        self.alone: dict[str, str | None] = {}

    @staticmethod
    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def replacement(self, value: int) -> str:
        return self.replacements[value : self.replacements.index(b"\0", value)].decode()

    def walk(self, data: bytes, at: int = 0) -> tuple[int, int, bool]:
        """(length of the longest key that data[at:] begins with, its value, whether the trie goes on after data)."""
        units = self.units
        node = self.offset(units[0])
        length = value = 0
        for i in range(at, len(data)):
            unit = units[node ^ data[i]]
            if unit & 0x800000FF != data[i]:
                return length, value, False
            node ^= data[i]
            node ^= self.offset(unit)
            if unit >> 8 & 1:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return length, value, any(units[node ^ b] & 0x800000FF == b for b in range(1, 256) if node ^ b < len(units))

    def single(self, c: str) -> str | None:
        """What a character becomes whatever follows it; None if what follows matters."""
        if c not in self.alone:
            data = c.encode()
            length, value, more = self.walk(data)
            self.alone[c] = None if more or 0 < length < len(data) else self.replacement(value) if length else c
        return self.alone[c]

    def prefixes(self, text: str):
        """(normal string, bytes of the original) of one prefix after the other."""
        data, at, rest = text.encode(), 0, 0
        for i, c in enumerate(text):
            width = len(c.encode())
            if rest:
                rest -= width  # within a key that began before
            elif (normal := self.single(c)) is not None:
                yield normal, width
            else:
                length, value, _ = self.walk(data, at)
                if 0 < length < width:
                    raise ValueError("a key of the character map ends within a character")
                yield (self.replacement(value), length) if length else (c, width)
                rest = max(length, width) - width
            at += width


class PieceModel(dict):
    """Maps a chunk of normal text to (ids as bytes, normal characters of each piece as bytes, decoded text).

    Holds REMEMBERED_CHUNKS chunks and, in `old`, as many that were remembered before.
    """

    def __init__(self, data: bytes):
        super().__init__()
        self.old: dict[str, tuple[bytes, bytes, str]] = {}
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("models that denormalise are not supported")
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.names = [p[1].decode() for p in pieces]
        self.kinds = kinds
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, kinds)) if kind == NORMAL}
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        order = {score: rank for rank, score in enumerate(sorted(set(scores), reverse=True))}
        self.ranks = {name: order[scores[i]] for name, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        by_byte = {int(name[3:5], 16): i for i, (name, kind) in enumerate(zip(self.names, kinds)) if kind == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if trainer.get(35) else None
        self.byte_of = {i: b for b, i in by_byte.items()}
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.neighbours = {name[i : i + 2] for name in self.ids for i in range(len(name) - 1)}
        self.bulk_tables()
        # Where no piece has a space behind another character, chunks begin at spaces.
        lead = not any(pair[1] == SPACE != pair[0] for pair in self.neighbours)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if lead else "(?s).+").findall

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normal text and, for each of its characters and its end, a byte offset in the original."""
        if not text:
            return "", np.zeros(1, np.int64)
        space = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze:
            data = np.frombuffer(text.encode(), np.uint8)
            starts = np.flatnonzero(data & 0xC0 != 0x80)
            lead = [0] if self.prefix else []
            return (space if self.prefix else "") + text.replace(" ", space), np.concatenate([lead, starts, [len(data)]]).astype(np.int64)
        out: list[str] = []
        align: list[int] = []
        at, blank, begun = 0, self.squeeze, False
        for normal, width in self.map.prefixes(text) if self.map.units else ((c, len(c.encode())) for c in text):
            if not begun and not (self.squeeze and normal == " "):
                begun = True
                if self.prefix:
                    out.append(space)
                    align.append(at)
            if begun:
                kept = normal.lstrip(" ") if blank else normal
                out.append(kept.replace(" ", space))
                align += [at] * len(kept)
                if kept:
                    blank = kept.endswith(" ")
                blank = blank and self.squeeze
            at += width
        normal = "".join(out)
        if self.squeeze:
            kept = len(normal.rstrip(space))
            if kept < len(normal):
                at = align[kept]
                normal = normal[:kept]
                del align[kept:]
        return normal, np.array([*align, at], np.int64)

    def cut(self, normal: str) -> list[str]:
        """Chunks across whose borders no piece reaches."""
        found = self.chunks(normal)
        if max(map(len, found), default=0) <= SHORT:
            return found
        parts: list[str] = []
        for chunk in found:
            start = 0
            if len(chunk) > SHORT:
                for i in range(1, len(chunk)):
                    if chunk[i - 1 : i + 1] not in self.neighbours:
                        parts.append(chunk[start:i])
                        start = i
            parts.append(chunk[start:])
        return parts

    def bulk_tables(self) -> None:
        """Symbols as numbers (pieces by id, other characters of pieces above them) and all pairs that merge, sorted."""
        symbols = dict(self.ids)
        for c in sorted({c for name in self.ids for c in name}):
            symbols.setdefault(c, len(self.names) + len(symbols))
        self.width = max(symbols.values(), default=0) + 1
        self.symbol_of = np.full(0x110000, STRANGE, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = i
        pairs = sorted(
            (symbols[name[:k]] * self.width + symbols[name[k:]], self.ranks[name], i)
            for name, i in self.ids.items() for k in range(1, len(name)) if name[:k] in symbols and name[k:] in symbols
        )
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array([p[k] for p in pairs] or [0], np.int64) for k in range(3))
        self.characters = np.array([len(name) for name in self.names], "<u4")

    def pairs_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, NONE where they don't merge; merged symbol) of neighbours."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE), self.pair_made[at]

    def merge_many(self, chunks: list[str]) -> np.ndarray:
        """Final symbols of chunks of up to SHORT characters, a row each, filled up with PAD.

        Each round merges the leftmost best pair of every row at once; rows without one are done.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        columns = np.arange(sizes.max())
        symbol = np.full((len(chunks), len(columns)), PAD, np.int32)
        symbol[columns < sizes[:, None]] = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        final = symbol.copy()
        rows = np.arange(len(chunks))
        ranks, made = self.pairs_of(symbol[:, :-1], symbol[:, 1:])
        while ranks.shape[1] and len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            live = ranks[every, at] < NONE
            if not live.all():
                final[rows[~live], : symbol.shape[1]] = symbol[~live]
                final[rows[~live], symbol.shape[1] :] = PAD
                rows, symbol, ranks, made, at = rows[live], symbol[live], ranks[live], made[live], at[live]
                every = np.arange(len(rows))
            if not len(rows):
                break
            new = made[every, at]
            columns = np.arange(symbol.shape[1] - 1)
            symbol = np.take_along_axis(symbol, columns + (columns > at[:, None]), axis=1)
            symbol[every, at] = new
            columns = columns[:-1]
            moved = columns + (columns >= at[:, None])
            ranks, made = np.take_along_axis(ranks, moved, axis=1), np.take_along_axis(made, moved, axis=1)
            for own, place in ((at > 0, at - 1), (at < len(columns), at)):
                r, c = every[own], place[own]
                ranks[r, c], made[r, c] = self.pairs_of(symbol[r, c], symbol[r, c + 1])
        final[rows, : symbol.shape[1]] = symbol
        final[rows, symbol.shape[1] :] = PAD
        return final

    def encode_new(self, chunks: list[str]):
        """(chunk, its entry) of chunks that aren't remembered. Those of like length are merged together."""
        chunks.sort(key=len)
        short = bisect.bisect_right(chunks, SHORT, key=len)
        for begin in range(0, short, ROWS_AT_ONCE):
            part = chunks[begin : min(short, begin + ROWS_AT_ONCE)]
            final = self.merge_many(part)
            plain = ((final < len(self.names)) & (final != STRANGE)).all(axis=1)
            ids = final[plain]
            ends = np.concatenate([[0], np.cumsum((ids >= 0).sum(axis=1))]).tolist()
            flat = ids[ids >= 0].astype("<u4")
            packed, sizes, names = flat.tobytes(), self.characters[flat].tobytes(), [self.names[i] for i in flat.tolist()]
            for chunk, b, e in zip(itertools.compress(part, plain), ends, ends[1:]):
                yield chunk, (packed[4 * b : 4 * e], sizes[4 * b : 4 * e], "".join(names[b:e]).replace(SPACE, " "))
            for chunk in itertools.compress(part, ~plain):
                yield chunk, self.entry(chunk)
        for chunk in chunks[short:]:
            yield chunk, self.entry(chunk)

    def entry(self, chunk: str) -> tuple[bytes, bytes, str]:
        ids, sizes = self.chunk_ids(chunk)
        packed = struct.Struct(f"<{len(ids)}I").pack
        return packed(*ids), packed(*sizes), self.decode(ids, strip=False)

    def merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk after all merges, by a priority queue over a linked list.

        An entry of the queue holds a rank and, in its low bits, a place.
        """
        symbol: list[str] = list(chunk)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, bits = self.ranks, n.bit_length()
        place = (1 << bits) - 1
        queue = [ranks[pair] << bits | i for i in range(n - 1) if (pair := chunk[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & place
            j = after[i]
            if j < 0 or not symbol[i] or ranks.get(symbol[i] + symbol[j]) != entry >> bits:
                continue  # stale: one of the two was merged meanwhile
            symbol[i] += symbol[j]
            symbol[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := ranks.get(symbol[i] + symbol[k])) is not None:
                    heapq.heappush(queue, found << bits | i)
            if (h := before[i]) >= 0 and (found := ranks.get(symbol[h] + symbol[i])) is not None:
                heapq.heappush(queue, found << bits | h)
        return [x for x in symbol if x]

    def chunk_ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a chunk's pieces and how many normal characters each has."""
        ids: list[int] = []
        sizes: list[int] = []
        for piece in self.merge(chunk):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
                sizes.append(len(piece))
            elif self.bytes:
                made = [self.bytes[b] for b in piece.encode()]
                ids += made
                sizes += [*[0] * (len(made) - 1), len(piece)]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(piece)
            else:
                ids.append(self.unknown)
                sizes.append(len(piece))
        return ids, sizes

    def entries(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes, str]]:
        """The entry of each chunk, remembered or made."""
        found, new = {}, []
        for chunk in chunks:
            if (made := self.get(chunk) or self.old.get(chunk)) is None:
                new.append(chunk)
            else:
                found[chunk] = made
        found.update(self.encode_new(new))
        for chunk in found if len(self) + len(new) > REMEMBERED_CHUNKS else new:
            if len(self) >= REMEMBERED_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = found[chunk]
        return found

    def encode_all(self, texts: list[str]):
        """(ids with begin and end, end bytes of their spans in the original, decoded text) of each text."""
        normal = [self.normalise(t) for t in texts]
        cut = [self.cut(n) for n, _ in normal]
        found = self.entries(set().union(*cut))
        for (_, align), chunks in zip(normal, cut):
            made = list(map(found.__getitem__, chunks))
            ids = np.frombuffer(b"".join([x[0] for x in made]), "<u4")
            sizes = np.frombuffer(b"".join([x[1] for x in made]), "<u4")
            if not self.bytes and len(ids):  # unknown characters next to each other are one piece, across chunks too
                first = np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]
                ids, sizes = ids[first], np.add.reduceat(sizes, np.flatnonzero(first))
            if self.bytes and not self.squeeze:
                decoded = "".join([x[2] for x in made])
                decoded = decoded[1:] if self.prefix and decoded.startswith(" ") else decoded
            else:
                decoded = self.decode(ids.tolist())
            ends = align[np.cumsum(sizes, dtype=np.int64)]
            ids = np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")
            yield ids, np.concatenate([[0], ends, align[-1:]]).astype(np.int64), decoded

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Piece texts in order; runs of byte pieces are read as UTF-8; the space put in front is taken away."""
        out: list[str] = []
        held = bytearray()
        leading = strip and (self.prefix or self.squeeze)
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
                leading = False
            kind, name = self.kinds[i], self.names[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                name = self.unknown_text
            elif leading and name.startswith(SPACE):
                name = name[1:]
                leading = self.squeeze and not name
            out.append(name if kind == UNKNOWN else name.replace(SPACE, " "))
            leading = leading and not out[-1]
        return "".join(out) + utf8(bytes(held))


def utf8(data: bytes) -> str:
    """As UTF-8, each byte that belongs to no character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as fault:
            out.append(data[at : at + fault.start].decode() + "\ufffd")
            at += fault.start + 1
    return "".join(out)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>), ``ends`` (array<long>), ``n_tokens`` and ``decoded``; other columns stay.

    Piece k spans the original's bytes from ends[k-1] (0 before the first) to ends[k]. Columns of those
    names that the input has already are replaced. The vocabulary file is read on every worker.
    """
    path = path or vocabulary_path()
    piece_model(path)
    new = ["ids", "ends", "n_tokens", "decoded"]
    out = docs.select(*[c for c in docs.columns if c not in new])
    schema = StructType(list(out.schema)).add("ids", ArrayType(IntegerType())).add("ends", ArrayType(LongType())).add("n_tokens", "long").add("decoded", "string")

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            made = list(model.encode_all([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([a.astype(np.int32) for a, _, _ in made], pa.list_(pa.int32())), pa.array([e for _, e, _ in made], pa.list_(pa.int64())),
                    pa.array([len(a) for a, _, _ in made], pa.int64()), pa.array([d for _, _, d in made], pa.string()),
                ],
                [*batch.schema.names, *new],
            )

    return common.by_batches(out, run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: as `encode_decode`, but ids, ends and decoded text leave the worker hashed."""
    path = path or vocabulary_path()
    piece_model(path)

    def run(batches):
        model = piece_model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for ids, ends, decoded in model.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                rows.append((len(ids), sha(ids.tobytes()), sha(decoded.encode()), sha(ends.astype("<i8").tobytes())))
            columns = [pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"
    return common.by_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ends_sha256, the digest of the spans' ends as 64-bit integers."""
    return digests(common.read(spark, sf_dir, "documents"))
