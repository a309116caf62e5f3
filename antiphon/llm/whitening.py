"""Whitening of vectors: distributed centred scatter, cyclic Jacobi on the driver, a broadcast matrix.

Entries are taken as integers x = floor(SCALE * c) + SHIFT.  The fit list holds each distinct x vector once
(n of them, with sums S by dimension): copies weigh nothing.  It is written once, and read for the sums, for
the scatter of x - S/n (rows of partial scatter matrices are added up by Spark), and for the check of the
result.  The driver gets numbers by dimension and pair of dimensions only, never rows.  Jacobi's rotations
go round all pairs of dimensions, disjoint pairs at once, until every off-diagonal entry vanishes beside its
diagonal ones, which keeps small eigenvalues accurate.  Eigenvectors get a positive largest entry.

Rows whose vector is null, or holds a null, a non-finite entry or one of 2**50 or more in size (no exact
integer then), take no part, nor do vectors of another length than the commonest (the shortest of those) or
of no entries at all: such rows give no result.  Components whose eigenvalue is not above 1e-13 of the
largest have no spread to divide by: their whitened values are 0, and the check leaves them out.  Repeated
rows and null ids keep their rows.  An empty table gives none.  A deviation that does not fit a long is an
error, not a wrong number.  Only the id and the vector are read, so other columns clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_row, discard, materialise, small_batches, summed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 1 << 50
LEAST = 1e-13


def quantised(vector: Column) -> Column:
    """The entries as integers, null for vectors that take no part."""
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float(LARGEST)))) & (F.size(vector) > 0)
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic rotations.

    A sweep meets every pair once, as in a round-robin: n / 2 disjoint rotations at a time."""
    n = len(matrix)
    a, v = matrix.astype(float).copy(), np.eye(n)
    ring = list(range(n + n % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:half], ring[:half - 1 : -1]) if x < n and y < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            live = abs(off) > np.finfo(float).eps * np.sqrt(abs(dp * dq))
            if not live.any():
                continue
            turned = True
            p, q, off, dp, dq = p[live], q[live], off[live], dp[live], dq[live]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            x, y = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    e = a.diagonal()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v * np.where(v[abs(v).argmax(0), np.arange(n)] < 0, -1.0, 1.0)


def _rows(b: pa.RecordBatch, d: int, at: int = 0) -> np.ndarray:
    return np.asarray(b.column(at).flatten()).astype(np.int64).reshape(-1, d)


class Whitening:
    """What a fit list gives: n, S, the eigenvalues' total, and for each component its value and vector."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.base = sums // max(n, 1)  # x - S/n as an exact integer less a fraction
        self.rest = (sums - n * self.base) / max(n, 1)
        live = values > LEAST * max(float(values.max(initial=0.0)), 1e-300)
        self.live = live
        self.matrix = np.where(live, vectors / np.sqrt(np.where(live, values, 1)), 0.0)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - S) ** 2, exact."""
        if self.n * float(abs(x).max(initial=0)) < 2**62:
            y = self.n * x - self.sums
            if float(abs(y).max(initial=0)) ** 2 * x.shape[1] < 2**62:
                return (y * y).sum(1)
        y = self.n * x.astype(object) - self.sums.astype(object)
        out = (y * y).sum(1)
        if out.max(initial=0) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return out.astype(np.int64)


def _sums(fits: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, np.int64)
        for b in batches:
            total[:d] += _rows(b, d).sum(0)
            total[d] += b.num_rows
        yield block_row(0, {"sums": total})

    got = summed(fits.mapInArrow(run, "block int, sums binary"), {"sums": (np.int64, np.int64)}, 1).collect()
    total = sum((np.frombuffer(r.sums, np.int64) for r in got), np.zeros(d + 1, np.int64))
    return int(total[d]), total[:d]


def _scatter(fits: DataFrame, d: int, k: int, project) -> np.ndarray:
    """The sum of the outer products of ``project(x)`` (k numbers) over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((k, k)), False
        for b in batches:
            z = project(_rows(b, d))
            total += z.T @ z
            some = True
        if some:
            for i in range(k):
                yield block_row(i, {"row": total[i]})

    out = np.zeros((k, k))
    for r in summed(fits.mapInArrow(run, "block int, row binary"), {"row": (np.float64, np.float64)}, k).collect():
        out[r.block] = np.frombuffer(r.row)
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's distinct vectors; None without any."""
    small_batches(vectors.sparkSession)
    x = vectors.select(quantised(F.col(vector_col)).alias("x")).filter("x is not null")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d").limit(1).collect()
    if not sizes:
        return None
    d = sizes[0].d
    fits = materialise(x.filter(F.size("x") == d).distinct(), "distinct")  # copies meet their like in each task first
    n, sums = _sums(fits, d)
    plain = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    values, basis = jacobi(_scatter(fits, d, d, plain.centred) / n)
    k = min(components, d)
    out = Whitening(n, sums, np.maximum(values[:k], 0), basis[:, :k], float(values.sum()))
    if out.live.any():
        check = _scatter(fits, d, k, out.whitened) / n
        out.identity_error = float(abs(check - np.eye(k))[np.ix_(out.live, out.live)].max())
    discard(fits)
    return out


def whiten(vectors: DataFrame, model: Whitening | None = None, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component: id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector_col, components) if model is None else model
    kind = vectors.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("x")).filter("x is not null")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, k = len(model.sums), model.matrix.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        part = m.values / m.trace if m.trace > 0 else np.zeros(k)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                now = b.slice(lo, 4096)
                x, many = _rows(now, d, 1), now.num_rows
                own = np.repeat(np.arange(many), k)
                yield pa.RecordBatch.from_arrays(
                    [now.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, m.n)), pa.array(m.deviation(x)[own]), pa.array(m.whitened(x).ravel()), pa.array(np.tile(part, many)), pa.array(np.full(many * k, m.identity_error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(F.size("x") == d).mapInArrow(run, schema).withColumnRenamed("id", id_col)
