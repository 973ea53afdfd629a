"""Language identification by a byte convolutional network (operator 8).

A text's UTF-8 bytes are cut into windows of a fixed length. Bytes are embedded, filters of widths
2, 3 and 4 slide over a window, the largest response of each filter feeds a softmax over languages;
a text's probabilities are those of its windows, averaged in logs by their length. Every window of
the whole text is read, in batches.

The network is trained in numpy on a sample whose bound is a parameter: of the labelled training
rows, `SAMPLE_DOCS` texts a language (those with the smallest hash) and `SAMPLE_WINDOWS` windows of
each, spread over the text. Only these windows reach the driver: 3,200 a language, so `lang` is taken
to hold language codes, not free text.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never learned from (a null id counts as
the empty text, so it is held out). `und`, score 0: the text is null or has no letter, or there was
nothing to learn from. Very long texts are read window by window; of equally likely languages the
first by name is taken. Ids may be repeated, each row gives one row; an empty table gives none; other
columns stay as they are, those named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 8
WINDOW_BYTES = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DEPTH = 6
EPOCHS = 8
SEED = 7
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def cut_windows(data: bytes, size: int = WINDOW_BYTES) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    n = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


class ByteCnn:
    """Filters of all widths are one matrix over the widest span; narrower ones have zeros there."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.span = languages, max(WIDTHS)
        self.mask = np.zeros((self.span, DEPTH, len(WIDTHS) * FILTERS), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(self.span * DEPTH, -1)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "bytes": f32(256, DEPTH, scale=0.5),
            "filters": f32(self.span * DEPTH, len(WIDTHS) * FILTERS, scale=0.3) * self.mask,
            "shift": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "out": f32(len(WIDTHS) * FILTERS, len(languages), scale=0.2),
            "bias": np.zeros(len(languages), np.float32),
        }

    def spans(self, windows: np.ndarray) -> np.ndarray:
        x = self.weights["bytes"][windows]
        n = windows.shape[1] - self.span + 1
        return np.concatenate([x[:, o : o + n] for o in range(self.span)], 2)

    def pooled(self, windows: np.ndarray):
        spans = self.spans(windows)
        found = spans @ self.weights["filters"]
        return spans, found, np.maximum(found.max(1) + self.weights["shift"], 0)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights["out"] + self.weights["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        return np.concatenate([self.log_probabilities(self.pooled(windows[i : i + batch])[2]) for i in range(0, len(windows), batch)])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n, w = len(windows), self.weights
        spans, found, pooled = self.pooled(windows)
        error = np.exp(self.log_probabilities(pooled))
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ w["out"].T) * (pooled > 0)
        best = found.argmax(1)  # the place of each filter's largest response gets its whole gradient
        chosen = np.take_along_axis(spans[:, :, None, :], best[:, None, :, None], 1)[:, 0]
        filters = np.einsum("nf,nfd->df", back, chosen) * self.mask
        per_span = back[:, :, None] * w["filters"].T[None]
        by_byte = np.zeros_like(w["bytes"])
        for o in range(self.span):
            at = np.take_along_axis(windows, best + o, 1)
            np.add.at(by_byte, at.ravel(), per_span[:, :, o * DEPTH : (o + 1) * DEPTH].reshape(-1, DEPTH))
        return {"bytes": by_byte, "filters": filters, "shift": back.sum(0), "out": pooled.T @ error, "bias": error.sum(0)}

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01) -> ByteCnn:
        rng = np.random.default_rng(SEED)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                step += 1
                for k, g in self.gradients(windows[order[i : i + batch]], labels[order[i : i + batch]]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


def sample_windows(docs: DataFrame, per_language: int = SAMPLE_DOCS, per_text: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """(lang, window) of the bounded training sample."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h"))
    # Hashes are even, so the smallest are found among a few times as many: no task sees all of a language.
    sizes = common.cut(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("size")))
    few = known.select("lang", "h").join(common.broadcast_if_small(sizes), "lang").filter((F.col("h") / 2.0**64 + 0.5) * F.col("size") <= 4 * per_language)
    first = Window.partitionBy("lang").orderBy("h")
    limits = few.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).groupBy("lang").agg(F.max("h").alias("most"))
    sampled = known.join(common.broadcast_if_small(common.cut(limits)), "lang").filter("h <= most").dropDuplicates(["lang", "h"])

    def run(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LETTER.search(text):
                    all_windows = cut_windows(text.encode("utf-8", "surrogatepass"))
                    for i in np.unique(np.linspace(0, len(all_windows) - 1, per_text).astype(int)):
                        rows.append((lang, all_windows[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "window"])

    made = common.by_batches(sampled.select("lang", "text"), run, "lang string, window binary").collect()
    return sorted((r["lang"], bytes(r["window"])) for r in made)  # at most languages x per_language x per_text


def train(docs: DataFrame, **bounds) -> ByteCnn | None:
    rows = sample_windows(docs, **bounds)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), WINDOW_BYTES)
    return ByteCnn(languages).train(windows, np.array([languages.index(lang) for lang, _ in rows]))


def classify(model: ByteCnn | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each text, from all its windows."""
    read = [(i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if model and t and LETTER.search(t)]
    found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not read:
        return found
    cuts = [cut_windows(data) for _, data in read]
    logs = model.predict(np.concatenate(cuts))
    at = 0
    for (i, data), own in zip(read, cuts):
        weight = np.full(len(own), WINDOW_BYTES, np.float64)
        weight[-1] = len(data) - (len(own) - 1) * WINDOW_BYTES
        p = np.exp((logs[at : at + len(own)] * weight[:, None]).sum(0) / weight.sum())
        p /= p.sum()
        at += len(own)
        found[i] = model.languages[int(p.argmax())], float(p.max())
    return found


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score; other columns stay (columns of those names are replaced)."""
    from pyspark.sql.types import StructType

    out = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = StructType(list(out.schema)).add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            made = classify(model, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return common.by_batches(out, run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, train(docs)).drop("text")
