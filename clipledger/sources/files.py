"""File inventories and digests, from file metadata where possible."""

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clipledger.vocabulary import VIDEO_SUFFIXES

#: Bytes that are read at once, and bytes of all files per task.
PIECE, TASK_BYTES = 8 << 20, 1 << 30


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time; file contents are not read. Spark lists no empty files."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def file_inventory(files: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Video records of all usable files, and the rejected files with a reason.

    ``probes`` supplies ``path, width, height, fps, frame_count``. The id hashes
    path, size and modification time in microseconds.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    stamp = F.unix_micros("modificationTime") if dict(files.dtypes)[
        "modificationTime"
    ].startswith("timestamp") else F.col("modificationTime").cast("bigint")
    joined = files.withColumn("__suffix", suffix).join(probes, "path", "left")
    positive = (
        (F.col("fps") > 0) & (F.col("frame_count") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    )
    checked = joined.withColumn(
        "reason",
        F.when(~F.col("__suffix").isin(VIDEO_SUFFIXES), "unsupported_suffix").when(
            ~F.coalesce(positive, F.lit(False)), "incomplete_metadata"
        ),
    )
    digest = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), stamp.cast("string")), 256)
    good = checked.filter("reason IS NULL").select(
        F.substring(digest, 1, 16).alias("video_id"),
        F.col("path").alias("source_path"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("file_size_bytes"),
        "width",
        "height",
        "fps",
        "frame_count",
        (F.col("frame_count") / F.col("fps")).alias("duration_seconds"),
    )
    return good, checked.filter("reason IS NOT NULL").select("path", "reason")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """A place that Arrow's file systems reach: local and shared mounts, HDFS, S3, GCS."""
    uri = re.sub("^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(quote(uri, safe=":/@?=&+"))


def _digest(store: fs.FileSystem, place: str, piece: int) -> tuple[int, str]:
    """Length and SHA-256 of a file, read piece by piece."""
    digest, length = hashlib.sha256(), 0
    with store.open_input_stream(place, compression=None) as source:
        while content := source.read(piece):
            digest.update(content)
            length += len(content)
    return length, digest.hexdigest()


def _inside(place: str, relative: str) -> str:
    """The place of a file below a folder; a path that leads out of it is an error."""
    if relative.startswith("/") or ".." in relative.split("/"):
        raise ValueError(f"{relative} is not below its folder")
    return f"{place}/{relative}"


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that each stand for a file: few rows are many bytes, so their partitions aren't coalesced."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_contents(
    spark: SparkSession, path: str, pattern: str = "*", piece: int = PIECE, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """``path, length, sha256`` of the content of every file below ``path``.

    Tasks read their files piece by piece, so a file may be larger than a cell or a
    worker's memory; there is a task per ``task_bytes`` of all files. Empty files aren't listed.
    """
    files = list_files(spark, path, pattern).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(*_located(name), piece) for name in batch.column(0).to_pylist()]
            lengths, digests = pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, digests], ["path", "length", "sha256"])

    return files.repartition(tasks, "path").select("path").mapInArrow(read, "path string, length long, sha256 string")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Content SHA-256 of every file below ``path``."""
    return read_contents(spark, path).select("path", "sha256")


def write_contents(rows: DataFrame, folder: str) -> None:
    """Every row's text ``content`` as the UTF-8 file ``path`` below a folder that all executors share.

    Tasks write their files themselves: one writer of Spark per file would cost more than the files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _located(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = _inside(place, path)
                above = target.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above)
                    made.add(above)
                with store.open_output_stream(target, compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    dealt = rows.select("path", "content").repartition(_tasks(rows), "path")
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()  # one number


def verify_contents(manifest: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """The manifest with ``length`` and ``status`` (``ok``, ``missing``, ``mismatch``) of its files.

    ``path`` is below ``folder``. Each row's file is opened where its row is, so nothing is
    listed or joined, and files of any number and size are read piece by piece.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _located(folder)

        def found(path: str) -> tuple[int | None, str | None]:
            try:
                return _digest(store, _inside(place, path), piece)
            except FileNotFoundError:
                return None, None

        for batch in batches:
            got = [found(path) for path in batch.column(at).to_pylist()]
            lengths, digests = pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lengths, digests], [*batch.schema.names, "length", "__actual"])

    at = manifest.columns.index("path")
    schema = StructType([*manifest.schema.fields, *StructType.fromDDL("length long, __actual string").fields])
    read_rows = manifest.repartition(_tasks(manifest), "path").mapInArrow(read, schema)
    return read_rows.select(*manifest.columns, "length", _status().alias("status"))


def _status() -> Column:
    """What ``sha256`` and the digest that was read say of a file."""
    return (
        F.when(F.col("__actual").isNull(), "missing")
        .when(F.col("__actual") == F.lower("sha256"), "ok")
        .otherwise("mismatch")
    )


def digest_verify(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Status of every manifest row: ``ok``, ``missing`` or ``mismatch``.

    Both sides have ``path, sha256``.
    """
    actual = digests.select("path", F.col("sha256").alias("__actual"))
    return manifest.join(actual, "path", "left").select(
        *manifest.columns, _status().alias("status")
    )
