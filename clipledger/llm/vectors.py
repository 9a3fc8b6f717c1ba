"""Vectors of finite numbers as arrays of integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest entry after scaling; float64 holds all integers up to here.
LIMIT = float(1 << 52)


def matrix(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(scale * entry) of these as integers)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * scale)
        good = (np.abs(values) <= LIMIT).all(1)
    return rows[good], values[good].astype(np.int64)


def dimension(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, of equally frequent ones the largest; 0 without vectors."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return most[0].n if most else 0


def packed(x: np.ndarray) -> list[bytes]:
    """The bytes of each row in the narrowest width that holds it, so equal rows have equal bytes."""
    size = np.abs(x).max(1, initial=0)
    out = np.empty(len(x), object)
    for width, least, most in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
        own = (size >= least) & (size < most)
        out[own] = [row.tobytes() for row in x[own].astype(width)]
    return out.tolist()


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.empty((len(column), width), np.int64)
    for k, row in enumerate(column):
        raw = row.as_buffer()
        out[k] = np.frombuffer(raw, f"<i{raw.size // width}")
    return out
