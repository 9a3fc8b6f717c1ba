"""Whitening of embeddings: exact covariance in Spark, eigenvectors by mixed-precision refinement.

1. Entries become integers, and each distinct vector of integers is taken once (the fit list).
2. Sums, then products centred at the integers next to the means, are added up by Spark
   without any rounding: tasks multiply in float64 while products and their sums stay below
   2^53, and carry digits of 2^20 beyond. So the covariance is an exact fraction.
3. float32 eigenvectors of it are corrected by matrix multiplications in extended precision
   (Ogita and Aishima's iteration), which doubles the right digits per step. Eigenvalues that
   lie too close for the correction are a cluster: its subspace is right, and a small
   eigenproblem of its own, shifted and scaled, turns the basis until all are apart.

The driver holds matrices of the dimension only, never rows.

Defined cases: vectors that are null, hold null or non-finite entries, entries whose 64-fold
lies beyond 2^52, or another length than most vectors have are left out. Null keys and repeated
rows are whitened like any other. Directions without variance give no component; an empty
table, or a fit list of one vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import modest_batches, save, with_columns
from clipledger.llm.vectors import dimension, matrix, packed, unpacked

COMPONENTS = 16
#: Entries become floor(SCALE * entry); a shift of all of them would cancel out of every result.
SCALE = 64
#: Rows of a product whose sums stay exact, and digits of larger numbers.
ROWS, DIGIT = 4096, 20
#: Steps of the refinement; it ends by itself once nothing is left to correct.
STEPS = 60
_WIDE = np.longdouble


def fit_list(vectors: DataFrame, column: str, width: int, scale: int) -> DataFrame:
    """(x): each distinct vector of integers once, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix(batch.column(0), width, scale)
            yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], ["x"])

    return vectors.select(column).mapInArrow(pack, "x binary").distinct()


# ---- exact sums ---------------------------------------------------------------------


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices d_0, d_1, ... below 2^DIGIT in size with y = d_0 + d_1 * 2^DIGIT + ..."""
    out = []
    while True:
        low = ((y + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not y.any():
            return out


def add_products(total: np.ndarray, y: np.ndarray) -> None:
    """Add y^T y to a matrix of Python integers, without rounding."""
    for first in range(0, len(y), ROWS):
        parts = _digits(y[first : first + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))


def _cells(values: np.ndarray, base: int = 40) -> dict[str, np.ndarray]:
    """Integers as hi * 2^base + lo in longs, so that Spark can add up those of many tasks."""
    flat = values.ravel()
    return {"hi": np.array([int(v) >> base for v in flat], np.int64), "lo": np.array([int(v) & ((1 << base) - 1) for v in flat], np.int64)}


def _summed(partial: DataFrame, size: int, base: int = 40) -> tuple[int, np.ndarray]:
    """(vectors, sums of the cells); ``size`` + 1 rows reach the driver."""
    out, n = np.zeros(size, object), 0
    for cell, count, hi, lo in partial.groupBy("cell").agg(F.sum("n"), F.sum("hi"), F.sum("lo")).collect():
        out[cell], n = (hi << base) + lo, max(n, count)
    return n, out


def sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(number of vectors, sum of each dimension)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = unpacked(batch.column(0), width)
            n, total = n + len(x), total + ((x >> 30).sum(0).astype(object) << 30) + (x & ((1 << 30) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(width), "n": np.full(width, n)} | _cells(total))

    return _summed(fit.mapInArrow(add, "cell long, n long, hi long, lo long"), width)


def products(fit: DataFrame, width: int, centre: np.ndarray) -> np.ndarray:
    """Sum of (x - centre)(x - centre)^T, exactly, for an integer centre."""
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width), object), 0
        for batch in batches:
            seen += batch.num_rows
            add_products(total, unpacked(batch.column(0), width) - centre)
        if seen:
            cells = _cells(total[upper])
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(upper[0])), "n": np.full(len(upper[0]), seen)} | cells)

    _, flat = _summed(fit.mapInArrow(add, "cell long, n long, hi long, lo long"), len(upper[0]))
    out = np.zeros((width, width), object)
    out[upper] = flat
    out.T[upper] = flat
    return out


def _wide(value: Fraction) -> np.longdouble:
    high = float(value)
    return _WIDE(high) + _WIDE(float(value - Fraction(high)))


def covariance(n: int, rest: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The covariance in extended precision from exact sums; ``rest`` is the sum of the centred vectors."""
    exact = squares * n - np.multiply.outer(rest, rest)
    return np.array([[_wide(Fraction(int(v), n * n)) for v in row] for row in exact], _WIDE).reshape(exact.shape)


# ---- eigenvectors --------------------------------------------------------------------


def _clusters(value: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two and more falling eigenvalues whose neighbours are at most ``near`` apart."""
    cuts = np.flatnonzero(-np.diff(value) > near) + 1
    return [x for x in np.split(np.arange(len(value)), cuts) if len(x) > 1]


def _subsolve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Turn the columns of ``x``, a cluster's basis, towards its eigenvectors.

    Within the cluster eigenvalues differ by little; shifted by their mean and scaled
    by their spread, the small problem is an ordinary one.
    """
    middle = np.trace(x.T @ a @ x) / x.shape[1]
    small = x.T @ (a @ x - middle * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size > 0:
        return x
    turn = np.linalg.eigh((small / size).astype(np.float64))[1][:, ::-1].astype(_WIDE)
    # the turn is orthogonal to float64 only: one Newton step makes it so in extended precision
    return x @ (turn @ (1.5 * np.eye(len(turn), dtype=_WIDE) - 0.5 * turn.T @ turn))


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix in extended precision.

    The start is float32's. A step takes the residuals R = I - X^T X and S = X^T A X and adds
    X E, where E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for eigenvalues that are apart and
    R_ij / 2 within a cluster, for which a sub-solve follows.
    """
    d = len(a)
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(d, _WIDE), np.eye(d, dtype=_WIDE)
    a = a / size
    value, x = np.linalg.eigh(a.astype(np.float32))
    x, unit, best = x[:, ::-1].astype(_WIDE), np.eye(d, dtype=_WIDE), np.inf
    kept = None
    for _ in range(STEPS):
        r, s = unit - x.T @ x, x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        left = max(float(np.abs(off + value * (r - np.diag(np.diag(r)))).max()), float(np.abs(r).max()))
        if left < best:
            best, kept = left, (value.copy(), x.copy())
        if left <= 8 * d * np.finfo(_WIDE).eps:
            break
        order = np.argsort(-value, kind="stable")
        x, value, r, s, off = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)], off[np.ix_(order, order)]
        near = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(r.astype(float)))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + value * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for own in _clusters(value, near):
            x[:, own] = _subsolve(a, x[:, own])
    value, x = kept
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    return value[order] * size, x / np.sqrt((x * x).sum(0))


# ---- the model ------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit list tells: n, sums (of x without the shift), eigenpairs, all of the dimension's size."""

    width: int
    scale: int
    n: int
    total: np.ndarray
    axes: np.ndarray
    value: np.ndarray
    share: np.ndarray
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened values of rows of integers."""
        centre = self.centre()
        rest = np.array([float(Fraction(int(s) - self.n * int(c), self.n)) for s, c in zip(self.total, centre)])
        return ((x - centre) - rest) @ self.axes / np.sqrt(self.value)

    def centre(self) -> np.ndarray:
        return np.array([(2 * int(s) + self.n) // (2 * self.n) for s in self.total], np.int64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exactly; None where a long can't hold it."""
        centre = self.centre()
        rest = [int(s) - self.n * int(c) for s, c in zip(self.total, centre)]
        y = x - centre
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, rest), default=0)
        if most * most * max(1, self.width) < 1 << 63:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((y.astype(object) * self.n - np.array(rest, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.value)
    shared = fit.sparkSession.sparkContext.broadcast(model)  # matrices of the dimension

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, seen = shared.value, np.zeros((k, k + 1)), 0
        for batch in batches:
            w = known.project(unpacked(batch.column(0), known.width))
            seen += len(w)
            total += np.column_stack([w.T @ w, w.sum(0)])
        if seen:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "v": total.ravel()})

    told = fit.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    shared.destroy()
    total = np.zeros(k * (k + 1))
    for cell, v in told:
        total[cell] = v
    total = total.reshape(k, k + 1) / model.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Learn from the distinct vectors of ``column``; None where nothing varies."""
    modest_batches(vectors.sparkSession)
    width = dimension(vectors, column)
    if not width:
        return None
    rows = save(fit_list(vectors, column, width, scale))
    n, total = sums(rows, width)
    if n < 2:
        return None
    model = Whitening(width, scale, n, total, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    centre = model.centre()
    rest = np.array([int(s) - n * int(c) for s, c in zip(total, centre)], object)
    cov = covariance(n, rest, products(rows, width, centre))
    value, axes = eigenvectors(cov)
    some = np.flatnonzero(value[:components] > width * np.finfo(float).eps * max(value[0], 0))
    if not len(some):
        return None
    model.axes, model.value = axes[:, some].astype(np.float64), value[some].astype(np.float64)
    model.share = (value[some] / np.trace(cov)).astype(np.float64)
    model.error = _identity_error(rows, model)
    return model


def whiten(vectors: DataFrame, model: Whitening | None, keys: list[str], column: str = "embedding") -> DataFrame:
    """A row per remaining row of ``vectors`` and component, with the columns ``keys``."""
    keyed = vectors.select(*keys)
    schema = with_columns(keyed.schema, component="int", n="long", deviation="long", whitened="double", explained="double", identity_error="double")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # matrices of the dimension
    names = schema.names

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k = len(known.value)
        for batch in batches:
            rows, x = matrix(batch.column(batch.num_columns - 1), known.width, known.scale)
            many = len(rows)
            at = pa.array(np.repeat(rows, k))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in range(len(keys))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, known.n)), pa.array(known.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(known.project(x).ravel()), pa.array(np.tile(known.share, many)), pa.array(np.full(many * k, known.error)),
                ],
                names,
            )

    return vectors.select(*keys, F.col(column).alias("_vector")).mapInArrow(spread, schema)


def whiten_embeddings(vectors: DataFrame) -> DataFrame:
    """``component`` 1 to 16 of every row of (vec_id, embedding)."""
    return whiten(vectors, fit(vectors), ["vec_id"])
