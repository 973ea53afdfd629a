"""BPE encoding and decoding (operator 3).

A word's symbols form a doubly linked list; a priority queue holds the merge ranks of neighbouring
pairs. The lowest rank is merged first, entries whose neighbours have changed meanwhile are stale
and skipped, and each merge queues at most two new pairs: O(n log n) for any word length.

Spark deals out the rows; a worker keeps the pieces of words it has seen in a bounded table.

Defined results: null text counts as empty (no tokens, empty decoded text); ids may be null or
repeated, each row gives one row; tables without rows give none; other columns are ignored.
Strings of special tokens in a text become those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import common

#: Words whose pieces one worker remembers, twice: the newest and those before.
REMEMBERED_WORDS = 150_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself where it is visible Latin-1, else from U+0100 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBpe(dict):
    """Maps a word to (ids joined by spaces, pieces so joined); missing ones are encoded.

    Holds REMEMBERED_WORDS words and, in `old`, as many that were in use before.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, tuple[str, str]] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.names = {i: s for s, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [self.ids[a + b] for a, b in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "$^")
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.symbols = byte_symbols()

    def merge(self, word: str) -> list[int]:
        """Ids of a word's pieces. A queue entry holds a rank and, in its low bits, a place."""
        text = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        text[-1] += self.end
        symbol: list[int] = [self.ids[x] for x in text]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, bits = self.ranks, n.bit_length()
        place = (1 << bits) - 1
        queue = [ranks[pair] << bits | i for i, pair in enumerate(zip(symbol, symbol[1:])) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & place, entry >> bits
            j = after[i]
            if j < 0 or ranks.get((symbol[i], symbol[j])) != rank:
                continue  # stale: one of the two was merged meanwhile
            symbol[i] = merged = self.merged[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := ranks.get((merged, symbol[k]))) is not None:
                    heapq.heappush(queue, found << bits | i)
            if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], merged))) is not None:
                heapq.heappush(queue, found << bits | h)
        return [x for x in symbol if x >= 0]

    def __missing__(self, word: str) -> tuple[str, str]:
        made = self.old.pop(word, None)
        if made is None:
            ids = self.merge(word)
            made = " ".join(map(str, ids)), self.decode(ids)
        if len(self) >= REMEMBERED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = made
        return made

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; the tokenizer file has no decoder, so a space stands between."""
        return " ".join(self.names[i] for i in ids)

    def normal(self, text: str) -> str:
        # Lower-casing by character: no special final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.pieces(text)[0].split()]

    def pieces(self, text: str) -> tuple[str, str]:
        """(ids joined by spaces, decoded text) of a whole text."""
        found: list[tuple[str, str]] = []
        at = 0
        for special in self.cut.finditer(text) if any(x in text for x in self.special) else ():
            found += map(self.__getitem__, self.words.findall(self.normal(text[at : special.start()])))
            found.append((str(self.special[special[0]]), special[0]))
            at = special.end()
        found += map(self.__getitem__, self.words.findall(self.normal(text[at:])))
        return " ".join([ids for ids, _ in found]), " ".join([names for _, names in found])


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>), ``n_tokens`` and ``decoded`` to the rows; other columns stay.

    Columns of those names that the input has already are replaced.
    """
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    out = docs.select(*kept)
    schema = StructType(list(out.schema)).add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded", "string")

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            made = [bpe.pieces(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = [[int(i) for i in a.split()] for a, _ in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array([d for _, d in made], pa.string())],
                [*batch.schema.names, "ids", "n_tokens", "decoded"],
            )

    return common.by_batches(out, run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: as `encode_decode`, but ids and decoded text leave the worker hashed."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = word_bpe(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            made = [bpe.pieces(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.count(" ") + bool(a) for a, _ in made], pa.int64()), pa.array([sha(a) for a, _ in made]), pa.array([sha(d) for _, d in made])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.by_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
