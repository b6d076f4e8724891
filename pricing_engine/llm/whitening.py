"""Embedding whitening by shifted CholeskyQR.

The centred rows X are never gathered.  Each pass sums the Gram matrix of the rows
times the inverse of the triangle found so far, task by task; its Cholesky factor,
with a small shift where rows may depend on each other, makes them more orthogonal
and is multiplied into the triangle.  When the rows are orthonormal, X = Q R, and the
singular values and right vectors of the small R are those of X.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricing_engine.session import staged

PASSES = 8  # at most; two or three are enough unless rows depend on each other
_UNIT = np.finfo(np.float64).eps / 2


@dataclass
class Whitening:
    """What the fit finds for vectors of one length."""

    n: int  # distinct vectors
    sums: list[int]  # of each dimension, exact
    values: np.ndarray  # of the covariance, falling
    vectors: np.ndarray  # a unit eigenvector a row
    explained: np.ndarray  # parts of the trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once: the whole part is taken off before the division."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` coordinates of rows, of unit variance; 0 along components without any."""
        scale = np.divide(1.0, np.sqrt(self.values[:k]), out=np.zeros(len(self.values[:k])), where=self.values[:k] > 0)
        return self.centred(x) @ self.vectors[:k].T * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) ** 2, in whole numbers of any size."""
        n, square = self.n, sum(s * s for s in self.sums)
        low = np.array([s & 0x3FFFFFFF for s in self.sums], np.int64)
        high = [s >> 30 for s in self.sums]
        if float(np.abs(x).max(initial=0)) >= 2**24 or max(map(abs, high), default=0) >= 2**30:
            return [sum((n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        squares, lows, highs = (x * x).sum(axis=1), x @ low, x @ np.array(high, np.int64)
        return [n * n * a - 2 * n * (b + (c << 30)) + square for a, b, c in zip(squares.tolist(), lows.tolist(), highs.tolist())]


def _rows(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, dims)


def _summed(rows: DataFrame, dims: int, part) -> np.ndarray:
    """The sum over all rows of ``part`` (rows -> dims by dims), of a matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            total += part(_rows(batch, "x", dims))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total))], names=["i", "row"])

    entries = rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((dims, dims))
    for i, j, v in entries.groupBy("i", "j").agg(F.sum("v")).collect():  # dims ** 2 numbers
        out[i, j] = v
    return out


def _solved(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangle ``r``, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def triangle(rows: DataFrame, dims: int, n: int, centred) -> np.ndarray:
    """R of the centred rows' QR factors, through shifted Cholesky factors of Gram matrices.

    The first pass is shifted, so that it cannot fail; later ones only if they would.
    What is left of the last Gram matrix G is put back as its root: X'X = R' G R, so
    directions without any variance, which no pass makes orthonormal, come out as zero.
    """
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = centred(x)
        for r in factors:
            q = _solved(r, q)
        return q.T @ q

    total = np.eye(dims)
    while True:
        g = _summed(rows, dims, gram)
        if not g.any():
            return np.zeros((dims, dims))
        spectrum = np.linalg.eigvalsh(g)
        if len(factors) == PASSES or factors and np.all((np.abs(spectrum - 1) < 1e-12) | (np.abs(spectrum) < 1e-12)):
            parts, basis = np.linalg.eigh(g)
            return np.sqrt(np.where(parts > 1e-12, parts, 0.0))[:, None] * basis.T @ total
        shift = 11 * (n * dims + dims * (dims + 1)) * _UNIT * spectrum[-1]
        shift = min(shift, spectrum[-1] / 100)
        plain = factors and spectrum[0] > 1e-3 * spectrum[-1]
        factors.append(np.linalg.cholesky(g if plain else g + shift * np.eye(dims)).T)
        total = factors[-1] @ total


def fit(vectors: DataFrame, dims: int) -> Whitening | None:
    """Whitening of the distinct vectors ``x`` (whole numbers, ``dims`` of them); None for none."""
    n = vectors.count()
    if not n:
        return None
    sums = [0] * dims
    total = F.sum(F.col("col").cast("decimal(38,0)"))
    for pos, s in vectors.select(F.posexplode("x")).groupBy("pos").agg(total).collect():  # a row a dimension
        sums[pos] = int(s)
    found = Whitening(n, sums, np.zeros(dims), np.eye(dims), np.zeros(dims))
    _, sizes, rows = np.linalg.svd(triangle(vectors, dims, n, found.centred))
    sizes = np.where(sizes > sizes.max(initial=0) * dims * 1e-12, sizes, 0.0)  # below: rounding
    found.values, found.vectors = sizes**2 / n, rows
    if found.values.sum() > 0:
        found.explained = found.values / found.values.sum()
    return found


def identity_error(vectors: DataFrame, dims: int, found: Whitening, k: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all."""
    live = int((found.values[:k] > 0).sum())
    if not live:
        return 0.0

    def covariance(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x, live)
        out = np.zeros((dims, dims))
        out[:live, :live] = w.T @ w
        return out

    return float(np.abs(_summed(vectors, dims, covariance)[:live, :live] / found.n - np.eye(live)).max())


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64()]


def whitened(rows: DataFrame, components: int = 4) -> DataFrame:
    """A row for each row of ``rows`` (vec_id, x: whole numbers) and component, numbered from 1.

    The fit is over each distinct x once, so repeated rows weigh nothing and get equal
    numbers.  Vectors of different lengths are whitened apart.  Rows with a null x or a
    null component are left out; a vector without components has no rows; null ids stay.
    Components are numbered by falling eigenvalue, up to ``components`` or the length;
    equal eigenvalues come in any order, the same for all rows.  Along a component of no
    variance (a single vector, dependent dimensions) whitened and explained are 0, and
    the identity error leaves it out.  No rows give no rows.
    """
    usable = F.coalesce(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()), F.lit(False))
    rows = rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<long>").alias("x"))
    distinct = staged(rows.select("x").distinct(), "vectors")
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().collect() if r[0]]
    models = {}
    for dims in sorted(lengths):
        own = distinct.filter(F.size("x") == dims)
        found = fit(own, dims)
        models[dims] = found, identity_error(own, dims, found, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy()
            for dims, (found, error) in models.items():
                own = batch.filter(pa.array(sizes == dims))
                if not own.num_rows:
                    continue
                x, k = _rows(own, "x", dims), min(components, dims)
                deviations = pa.array(found.deviations(x), pa.decimal128(38, 0))
                w = found.whitened(x, k)
                for c in range(k):
                    same = [pa.array(np.full(len(x), v), t) for v, t in ((c + 1, _TYPES[1]), (found.n, _TYPES[2]))]
                    rest = [pa.array(w[:, c]), *(pa.array(np.full(len(x), v)) for v in (found.explained[c], error))]
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), *same, deviations, *rest], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
