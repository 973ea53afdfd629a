"""The corpus pipeline, stage by stage, against plain versions."""

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, common, langid, line_dedup

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    model = langid.train(common.read(spark, SF, "documents"))
    fits = langid.classify(model, [d["text"] for d in docs])
    docs = [d for d, (lang, score) in zip(docs, fits) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    for d, t in zip(docs, brute.line_dedup([(d["doc_id"], d["text"], d["source"]) for d in docs], line_dedup.LEAST_SITES)):
        d["text"] = t
    docs.sort(key=lambda d: d["doc_id"])
    group = brute.components([brute.fingerprint(d["text"]) for d in docs])
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    clean = [not x[-1] for x in brute.contamination([(d["doc_id"], d["text"]) for d in docs], items)]
    docs = [d for d, ok in zip(docs, clean) if ok]
    reference = Tokenizer.from_file(bpe.vocabulary_path())
    expected = []
    for d in docs:
        ids = reference.encode(d["text"], add_special_tokens=False).ids
        expected.append((d["doc_id"], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(reference.decode(ids, skip_special_tokens=False))))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == sorted(expected)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns(spark):
    docs = common.read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_boilerplate_spares_copies(spark):
    """A document copied on many sites keeps its lines; a line of as many different documents goes."""
    table = [(k, "copied one\ncopied two", None, f"s{k}", 1) for k in range(12)] + [(100 + k, f"own {k}\neverywhere", None, f"s{k}", 1) for k in range(12)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_boilerplate(spark, docs, SF).collect()}
    assert got == {k: "copied one\ncopied two" for k in range(12)} | {100 + k: f"own {k}" for k in range(12)}
