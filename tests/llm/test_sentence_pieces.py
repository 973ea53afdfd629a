"""Operator 11 against the sentencepiece library: ids, decoded text and byte spans."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tessera.llm import common, sentence_pieces

random.seed(11)
ALPHABET = list("abe the of ▁  \n\t019éß日本語€😀\u0000�́ﬁ㍿Å①ｶﾞ­​　") + ["<s>", "</s>", "<0x41>", "<unk>"]
TEXTS = ["", " ", "   ", "▁", "▁▁ a", " 　 ", *("".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(1500))]
VARIANTS = [
    {}, {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, {"rule": "nmt_nfkc_cf"}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False},
    {"bytes": False}, {"add_dummy_prefix": False, "remove_extra_whitespaces": True, "rule": "nfkc"},
]


def model(rule=None, bytes=True, **settings) -> bytes:
    """The public model with another character map or other settings."""
    made = sentencepiece_model_pb2.ModelProto()
    with open(sentence_pieces.vocabulary_path(), "rb") as file:
        made.ParseFromString(file.read())
    if rule:
        other = sentencepiece_model_pb2.ModelProto()
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        made.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for name, value in settings.items():
        setattr(made.normalizer_spec, name, value)
    if not bytes:
        made.trainer_spec.byte_fallback = False
        for piece in made.pieces:
            piece.type = 1 if piece.type == 6 else piece.type
    return made.SerializeToString()


@pytest.mark.parametrize("variant", VARIANTS, ids=str)
def test_against_library(variant):
    data = model(**variant)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentence_pieces.PieceModel(data)
    for text in TEXTS:
        ids, ends, decoded = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert decoded == library.decode(ids.tolist()) == own.decode(ids.tolist())
        assert ends.tolist()[1:-1] == [p.end for p in library.encode(text, return_type="proto").pieces]
    for _ in range(1500):
        ids = [random.choice([random.randrange(32000), random.randrange(3, 259), 259, 0, 1, 2]) for _ in range(random.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_other_models_are_refused():
    made = sentencepiece_model_pb2.ModelProto()
    made.ParseFromString(model())
    made.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(made.SerializeToString())


def test_long_chunk():
    """A chunk of 200,000 characters, and two of them that share their borders' characters with no piece."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())
    own = sentence_pieces.piece_model(sentence_pieces.vocabulary_path())
    for text in ("ab" * 100_000, "日" * 50_000 + "7" * 50_000 + "the" * 20_000):
        assert own.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_remembered_chunks_do_not_change_results(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED_CHUNKS", 3)
    with open(sentence_pieces.vocabulary_path(), "rb") as file:
        own = sentence_pieces.PieceModel(file.read())
    kept = sentence_pieces.piece_model(sentence_pieces.vocabulary_path())
    for text in TEXTS[:300]:
        assert own.encode(text)[0].tolist() == kept.encode(text)[0].tolist()


def test_tables(spark):
    """Nulls, empty and repeated rows, clashing columns, no rows."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())
    texts = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "日本 the\n" * 2000), (4, "\u0000"), *((10 + k, t) for k, t in enumerate(TEXTS[:200]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "ends", "decoded", "n_tokens", "other")}).repartition(3)
    made = sentence_pieces.encode_decode(docs)
    assert made.columns == ["doc_id", "text", "other", "ids", "ends", "n_tokens", "decoded"]
    key = lambda r: str(tuple(r))
    got = sorted(((r.doc_id, r.ids, r.decoded, r.n_tokens) for r in made.collect()), key=key)
    plain = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts]
    assert got == sorted(((i, ids, library.decode(ids), len(ids)) for i, ids in plain), key=key)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.digests(docs).collect()), key=key)
    assert got == sorted(((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())) for i, ids in plain), key=key)
    assert sentence_pieces.encode_decode(docs.limit(0)).count() == sentence_pieces.digests(docs.limit(0)).count() == 0


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = sentence_pieces.op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
