"""Operator 12 against numpy's eigenvectors and exact integer sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, whitening


def plain(rows, most=16):
    """(rows kept, n, eigenvalues, eigenvectors, trace, mean, deviation by vector)."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(x, total)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return kept, n, values[order], vectors[:, order], np.trace(v), total


def check(got, rows):
    kept, n, values, vectors, trace, total = plain(rows)
    sound = values > whitening.RANK * values[0]
    values, vectors = values[sound], vectors[:, sound]
    k = len(values)
    assert len(got) == len(kept) * k
    key = lambda r: (r[0] is None, r[0] or 0)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained and r.identity_error <= 1e-6
    signs = None
    for i, x in sorted(kept, key=key):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        centred = np.array([float(Fraction(c * n - s, n)) for c, s in zip(x, total)])
        expected = centred @ vectors / np.sqrt(values)
        mine = by[i, deviation]
        options = np.array([mine[c + 1][:1] for c in range(k)]).ravel()
        signs = np.sign(options * expected) if signs is None else signs
        signs = np.where(signs == 0, np.sign(options * expected), signs)
        assert np.allclose(options, expected * np.where(signs == 0, 1, signs), atol=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in common.read(spark, folder, "embeddings").collect()]
    check(whitening.op12_whitening(spark, folder).collect(), rows)


def test_hard_rows(spark):
    """Null, empty, short and non-finite vectors, repeats and null ids, a constant dimension, clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 3, 1, 0, 0.1]]) for i in range(200)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1])] + [(500 + i, rows[0][1]) for i in range(300)]
    extra = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.inf] * 5), (903, [math.nan, 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0]), (906, [1e30] * 5)]
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "n", "d", "count")})
    check(whitening.whiten(table.repartition(4)).collect(), rows)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)).collect()
    assert sorted(round(r.whitened, 9) for r in got) == [-1, 1] and {r.deviation for r in got} == {64**2}


def test_deviation_beyond_long():
    centre = whitening.Centre(3, [0, 3 * 2**30 + 1])
    x = np.array([[2**30, 2**30], [2**33, 5]], np.int64)
    exact = [9 * 2**60 + 1, None]
    assert centre.deviations(x) == [exact[0] if exact[0] < 2**63 else None, None]
    x = np.array([[2**29, 2**30]], np.int64)
    assert centre.deviations(x) == [(3 * 2**29) ** 2 + 1]


SPECTRA = {
    "spread": lambda n: 10.0 ** -np.arange(n), "equal": lambda n: np.ones(n), "pairs": lambda n: np.repeat(np.arange(n, 0, -2.0), 2)[:n],
    "close": lambda n: 1 + 1e-9 * np.arange(n), "zero": lambda n: np.r_[np.arange(n // 2, 0, -1.0), np.zeros(n - n // 2)], "one": lambda n: np.r_[1e6, np.ones(n - 1)],
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_components(name, n):
    """Values to rounding, vectors orthonormal and invariant, whatever the spectrum; no eigenvalue routine beside it."""
    spectrum = SPECTRA[name](n)[:n]
    q, _ = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.components(v, min(n, 16))
    assert np.allclose(values, np.sort(spectrum)[::-1][: len(values)], atol=1e-13 * n * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values) <= 1e-12 * n * spectrum.max()
    full, _ = whitening.components(v, n)
    assert np.isclose(full.sum(), spectrum.sum())
