"""Embedding whitening by spectral divide and conquer (operator 12).

Entries become integers (64ths, shifted), the fit list holds each distinct vector once. Spark sums the
fit list's columns, then the centred products of each partition; what reaches the driver is one number
per pair of dimensions. There the covariance is split without any eigenvalue routine: the polar
factor U of V - shift*I, found by QR-based dynamically weighted Halley steps (QDWH), gives the spectral
projector (U + I) / 2 on the eigenvalues above the shift. Its range and the rest of the space are invariant,
so V is compressed to each and split again until a component stands alone. Subspaces below the wanted
components are not split. The components, scaled, are broadcast, and every row is projected.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as
are entries beyond 2**56, whose integers a long can't hold. Vectors of another length than the
commonest (of equally common ones the longest) have no place in the covariance and are dropped too.
Repeated rows and ids and null ids give their rows each; they count once in the fit list. Components
whose eigenvalue is zero but for rounding (below RANK of the largest) can't be scaled and are left out, so
one distinct vector alone, or an empty table, gives no rows. A deviation that a long can't hold is null.
Equal eigenvalues have an arbitrary orthonormal basis. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Components returned.
COMPONENTS = 16
#: Dimensions that the driver's covariance may have.
MOST_DIMENSIONS = 2048
#: Eigenvalues below this share of the largest count as zero.
RANK = 1e-11
SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / n  # below the least singular value, or that counts as zero
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(orthonormal basis, k): its first k columns span the eigenvectors above some shift. None if nothing splits `a`."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * EPS * np.linalg.norm(a):
        return None
    best = None
    # The median halves the work; the mean lies between the extremes; the others leave an eigenvalue that one of these hits.
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * f for f in (0.0618, -0.0618, 0.0382, -0.0382, 0.00618, -0.00618))):
        u = polar(a - shift * np.eye(n)) if n > 1 else np.ones((1, 1))
        projector = (u + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        start = np.random.default_rng(n).standard_normal((n, k))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ start, mode="complete")
            start = basis[:, :k]
        error = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or error < best[0]:
            best = error, basis, k
        if error <= 8 * np.sqrt(n) * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the `most` largest of a symmetric matrix."""
    found: list[np.ndarray] = []
    todo = [np.eye(len(v))]  # bases of invariant subspaces, the one with the largest eigenvalues last
    while todo and len(found) < most:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        parts = split(a) if len(a) > 1 else None
        if parts is None:
            found += list(basis.T)
            continue
        inner, k = parts
        todo += [basis @ inner[:, k:], basis @ inner[:, :k]]
    vectors = np.array(found).T
    # What rounding has left between the found ones goes: orthonormal again, values from v itself.
    vectors, triangle = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(triangle))
    values = np.einsum("ij,ik,kj->j", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
    return values[order], vectors * signs


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the vector in integers; rows without a finite vector are dropped."""
    limit = float(1 << 56)
    bad = F.exists(vector, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) > limit), F.lit(True)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension); a partition gives one row per dimension, in two 32-bit halves."""

    def run(batches):
        n, high, low = 0, [0] * length, [0] * length
        for batch in batches:
            x = matrix(batch.column(0))
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 32).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([n] * length, pa.int64())], ["d", "high", "low", "n"])

    parts = common.by_batches(fit, run, "d int, high long, low long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = sorted(parts.groupBy("d").agg(whole("high"), whole("low"), F.sum("n").alias("n")).collect())
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]


class Centre:
    """The mean S/n as an integer and a rest, so that centring large integers loses nothing."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.whole = [round(Fraction(s, n)) for s in total]
        self.rest = [s - n * w for s, w in zip(total, self.whole)]

    def near(self, x: np.ndarray) -> np.ndarray:
        return x - np.array(self.whole, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.near(x) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n*x - S)**2 by row; None beyond a long."""
        near = self.near(x)
        rough = ((near.astype(float) * self.n - np.array(self.rest, float)) ** 2).sum(axis=1)
        if len(x) and rough.max() < 2**62:
            return ((near * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - r) ** 2 for a, r in zip(row, self.rest)) if guess < 2**64 else 2**63 for row, guess in zip(near, rough)]
        return [e if e < 2**63 else None for e in exact]


def products(fit: DataFrame, length: int, project) -> np.ndarray:
    """Sum of the outer products of project(x) over all rows; a partition gives its upper triangle once."""
    upper = np.triu_indices(length)

    def run(batches):
        total = np.zeros((length, length))
        for batch in batches:
            y = project(matrix(batch.column(0)))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * length + upper[1], pa.int64()), pa.array(total[upper])], ["at", "part"])

    found = common.by_batches(fit, run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).toPandas()
    total = np.zeros(length * length)
    total[found["at"]] = found["part"]
    total = total.reshape(length, length)
    return np.triu(total) + np.triu(total, 1).T


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row per remaining row of `rows` and component: its whitened value, with the fit's figures."""
    spark = rows.sparkSession
    table = integers(rows, vector)
    with common.scratch(spark) as write:
        fit = write(table.select("x").distinct())
        commonest = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if commonest is None:
            return spark.createDataFrame([], SCHEMA)
        length = commonest["d"]
        if length > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {length} dimensions; at most {MOST_DIMENSIONS} fit the driver")
        fit = fit.filter(F.size("x") == length)
        n, total = sums(fit, length)
        centre = Centre(n, total)
        v = products(fit, length, centre.centred) / n
        values, vectors = components(v, min(most, length))
        sound = values > RANK * max(values[0], 0)
        if not values[0] > 0:
            return spark.createDataFrame([], SCHEMA)
        values, vectors = values[sound], vectors[:, sound]
        weights = vectors / np.sqrt(values)
        identity = products(fit, len(values), lambda x: centre.centred(x) @ weights) / n
    error = float(np.abs(identity - np.eye(len(values))).max())
    explained = values / np.trace(v)
    # Dimensions times components: bounded by MOST_DIMENSIONS, whatever the rows.
    shared = spark.sparkContext.broadcast((centre, weights, explained, error))

    def run(batches):
        centre, weights, explained, error = shared.value
        k = len(explained)
        for batch in batches:
            x = matrix(batch.column(1))
            m = len(x)
            every = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                    pa.array(centre.deviations(x), pa.int64()).take(every), pa.array((centre.centred(x) @ weights).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return common.by_batches(table.filter(F.size("x") == length), run, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings"))
