"""Word-piece token counts by a linear longest-match automaton (operator 4).

The vocabulary is a trie with two roots: one for the first piece of a word, one for the pieces that
continue it. A node that the greedy longest match has to leave has a failure link to the node where
matching goes on and the number of pieces popped on the way. One pass over a word's characters then
gives the number of its pieces; no piece is built and no character is read twice.

Words stand between ASCII white space. A word that can't be cut counts as one unknown token.

Defined results: null or blank text has no words and no tokens; ids may be null or repeated, each
row gives one row; an empty table gives none; a very long text is a batch of its own and costs memory in
proportion to its length; greedy longest matching leaves no ties; other columns stay out of the way
(`count_tokens` keeps them, and replaces those named like its own).
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

REMEMBERED_WORDS = 200_000
WORD_MARK = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[set[str], set[str]]:
    """(pieces that begin a word, pieces that continue one) of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = set(), set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            (first if piece.startswith(WORD_MARK) else later).add(piece.removeprefix(WORD_MARK))
    return first - {""}, {x for x in later if x and WORD_MARK not in x}


class LongestMatch:
    """children[v]: next nodes by character; fail[v]: node after popping, -1 if none; popped[v]: pieces popped."""

    FIRST, LATER = 0, 1

    def __init__(self, first: set[str], later: set[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((self.FIRST, first), (self.LATER, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        whole.append(False)
                    at = self.children[at][c]
                whole[at] = True
        self.fail = [-1] * len(whole)
        self.popped = [0] * len(whole)
        level = [self.FIRST, self.LATER]
        while level:
            below = []
            for parent in level:
                for c, node in self.children[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.fail[node], self.popped[node] = self.LATER, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.children[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.children[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word, -1 if it can't be cut."""
        at, n = self.FIRST, 0
        children, fail, popped = self.children, self.fail, self.popped
        for c in word:
            while c not in children[at]:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = children[at][c]
        while at != self.LATER:
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n


@lru_cache(2)
def longest_match(path: str) -> LongestMatch:
    return LongestMatch(*load_pieces(path))


class Counts(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(word.decode("utf-8", "surrogatepass"))
        return n


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add n_words, n_tokens and n_unknown (words that count as one unknown token); other columns stay."""
    path = path or vocabulary_path()
    new = ["n_words", "n_tokens", "n_unknown"]
    out = docs.select(*[c for c in docs.columns if c not in new])
    schema = StructType(list(out.schema))
    for c in new:
        schema = schema.add(c, "long")

    def run(batches):
        counts = Counts(longest_match(path))
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                words = Counter((value or "").encode("utf-8", "surrogatepass").split())
                pieces = [(counts[w], n) for w, n in words.items()]
                unknown = sum(n for p, n in pieces if p < 0)
                rows.append((sum(n for _, n in pieces), sum(p * n for p, n in pieces if p > 0) + unknown, unknown))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], [*batch.schema.names, *new]
            )

    return common.by_batches(out, run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return count_tokens(docs.select(F.col("doc_id").cast("long"), "text")).drop("text")
