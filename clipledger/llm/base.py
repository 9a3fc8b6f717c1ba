"""What the corpus operators share: shared storage, numbering, vectors of words.

Arrays are made from whole Arrow columns, a bounded slice of rows at a time, so
memory follows the slice (or one very long text), never the task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


def working_folder(spark: SparkSession) -> str:
    """A fresh folder in the storage that ``spark.checkpoint.dir`` names.

    Local sessions without the setting get a temporary folder; on a cluster the
    setting is required, because executors don't share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def modest_batches(spark: SparkSession) -> None:
    """Send Python workers at most 1,000 rows or 4 MB at once, unless the session asks for less.

    Texts differ in length by orders of magnitude, so Spark's 10,000 rows can be a lot of memory.
    """
    for name, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.sub("[bB]$", "", spark.conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back: later steps start there."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_columns(schema: StructType, **columns: str) -> StructType:
    """A new schema with these columns (name=type name) at the end."""
    return StructType(schema.fields + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in columns.items())).fields)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def blocks_for(rows: int, per_block: int = 50_000, least: int = 64) -> int:
    return max(least, -(-rows // per_block))


def number_rows(df: DataFrame, name: str, keys: list[str], spread: list[str], order: list[str], blocks: int) -> DataFrame:
    """Add a gapless number from 0 per ``keys``, without one task per key.

    Rows are dealt to ``blocks`` blocks by a hash of ``spread``; a window
    numbers each (keys, block), and one row per (keys, block) is summed up.
    ``df`` is read twice, so pass a stored table.
    """
    block = F.pmod(F.xxhash64(*spread), F.lit(blocks)).cast("int")
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    numbered = df.withColumn("_at", F.row_number().over(inner) - 1)
    joined = numbered.join(starts, [*keys, "_block"])
    return joined.withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_block")


# ---- Arrow columns as arrays ------------------------------------------------


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null as ''."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, UTF-8 bytes, offsets) of slices of about ``limit`` bytes; null as ''."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the words between spaces and bytes 9 to 13."""
    inside = np.empty(len(data) + 1, dtype=bool)
    np.logical_not(_GAP[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    ends = inside[:-1] & ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: summed random values of (place, byte), then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    # the letters of all words one after another, with the place of each in its word
    step = np.arange(int(size.sum()), dtype=np.int32)
    place = step - np.repeat(first.astype(np.int32), size)
    letter = data[step + np.repeat((starts - first).astype(np.int32), size)]
    part = _TABLE[((place & 63) << 8) | letter]
    if int(size.max()) > 64:
        part *= mix((place >> 6).astype(np.uint64)) | _U(1)
    return mix(np.add.reduceat(part, first) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def row_starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one after another."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(starts - first, counts)
