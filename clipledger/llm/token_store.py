"""Token ids in raw shard files, and a minimal perfect hash index over the document keys.

Files (all numbers little-endian)

* ``ids-<shard>.bin``: 16-byte header ``TOKIDS1\\0``, bytes per id (u4), zero (u4);
  then the ids of the shard's documents, in ascending key order, nothing between.
* ``index-<part>.bin``: 8-byte magic ``TOKMPH1\\0``, keys (u4), levels (u4), per level
  its bits (u4); the levels as u8 words; ones before every word (u4); then one
  24-byte record per key: fingerprint (u8), shard (u4), ids (u4), first id in the
  shard (u8).

The index is a cascade of bit arrays: on every level a key claims one bit, keys
alone on theirs keep it, the others go on. A key's record is the number of ones
before its bit, so a look-up reads a few words and one record, and the stored
fingerprint rejects keys that were never indexed. Index parts are made by hash of
the key, each by its own task, from about ``PART_KEYS`` keys.

Tasks write under names of their own and only the files that a finished task
reported are read, so a repeated task after a lost executor does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.base import mix, modest_batches, save, with_columns, working_folder
from clipledger.llm.tokens import encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
SHARD_ROWS, PART_KEYS = 8_000, 50_000
LOAD, LEVELS = 1.5, 40
RECORD = np.dtype([("print", "<u8"), ("shard", "<u4"), ("ids", "<u4"), ("start", "<u8")])
_U = np.uint64


# ---- one index part -----------------------------------------------------------


def key_hashes(keys: np.ndarray, copies: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of (document key, copy): the copy tells repeated rows of a key apart, -1 is a null key."""
    copies = np.broadcast_to(np.asarray(copies, np.int64), keys.shape).astype(np.uint64)
    return mix(mix(keys.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15)) + copies * _U(0xD6E8FEB86659FD93))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5))


def _spot(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(hashes + _U((level * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)) % _U(bits)).astype(np.int64)


def build_index(hashes: np.ndarray, shard: np.ndarray, start: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of an index part over the distinct hashes of its keys."""
    levels, left = [], hashes
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys of an index part must be distinct")
        bits = -(-max(64, int(LOAD * len(left))) // 64) * 64
        spot = _spot(left, len(levels), bits)
        alone = np.bincount(spot, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[spot]]
    index = Index._of(levels, np.zeros(0, RECORD))
    records = np.zeros(len(hashes), RECORD)
    at = index.slots(hashes)
    records["print"][at], records["shard"][at], records["ids"][at], records["start"][at] = fingerprints(hashes), shard, ids, start
    head = b"TOKMPH1\0" + np.array([len(hashes), len(levels), *(len(x) * 64 for x in levels)], "<u4").tobytes()
    return head + b"".join(x.tobytes() for x in levels) + index.before.astype("<u4").tobytes() + records.tobytes()


class Index:
    """An index part, from its bytes."""

    @classmethod
    def _of(cls, levels: list[np.ndarray], records: np.ndarray) -> Index:
        self = cls.__new__(cls)
        self.bits = [len(x) * 64 for x in levels]
        self.words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before, self.records = np.cumsum(ones) - ones, records
        return self

    def __init__(self, raw: bytes):
        if raw[:8] != b"TOKMPH1\0":
            raise ValueError("not an index part")
        n, levels = np.frombuffer(raw, "<u4", 2, 8).tolist()
        self.bits = np.frombuffer(raw, "<u4", levels, 16).tolist()
        at, words = 16 + 4 * levels, sum(self.bits) // 64
        self.words = np.frombuffer(raw, "<u8", words, at)
        self.before = np.frombuffer(raw, "<u4", words, at + 8 * words).astype(np.int64)
        self.records = np.frombuffer(raw, RECORD, n, at + 12 * words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The record number of each key; -1 for some keys that aren't in the index."""
        out = np.full(len(hashes), -1, np.int64)
        open_, base = np.arange(len(hashes)), 0
        for level, bits in enumerate(self.bits):
            spot = _spot(hashes[open_], level, bits) + base
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & _U(1) == 1
            under = self.words[word[hit]] & ((_U(1) << bit[hit]) - _U(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            open_, base = open_[~hit], base + bits
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(records, found); where a key was never indexed, found is false."""
        at = self.slots(hashes)
        if not len(self.records):
            return np.zeros(len(hashes), RECORD), np.zeros(len(hashes), bool)
        records = self.records[np.maximum(at, 0)]
        return records, (at >= 0) & (records["print"] == fingerprints(hashes))


# ---- files that all executors reach --------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_bytes(path: str, parts: Iterable) -> None:
    store, place = _place(path)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as out:
        for part in parts:
            out.write(part)


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    store, place = _place(path)
    with store.open_input_file(place) as source:
        return source.read_at(source.size() - start if size is None else size, start)


def read_ids(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids of a shard file from id ``start`` on."""
    head = read_bytes(path, 0, 16)
    if head[:8] != b"TOKIDS1\0":
        raise ValueError("not a file of ids")
    width = int(np.frombuffer(head, "<u4", 1, 8)[0])
    return np.frombuffer(read_bytes(path, 16 + start * width, count * width), f"<u{width}")


# ---- on Spark -------------------------------------------------------------------


def write_store(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 2, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write ids of (doc_id, text) below ``folder``; returns (keys, shards, index parts).

    A null or empty text is its end id alone. Rows that repeat a key are its copies
    0, 1, .. in order of text; null keys come first, as copies of key 0 below zero.
    ``keys`` has every (doc_id, copy); without rows all three are empty.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.count()
    shards = max(1, -(-rows // shard_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys, counts = encoder(tokenizer_path(tokenizer)), [], []

        def pieces() -> Iterator[memoryview]:
            for batch in batches:
                keys.append(batch.column(0))
                for _, _, ids, at in encode.column(batch.column(1)):
                    own = np.diff(at)
                    whole = np.full(len(ids) + len(own), end_id, encode.width)
                    here = np.ones(len(whole), bool)
                    here[np.cumsum(own + 1) - 1] = False
                    whole[here] = ids
                    counts.append(own + 1)
                    yield memoryview(whole).cast("B")

        # ids go to the file as they come; keys and counts are all that a task holds
        coming = pieces()
        first = next(coming, None)
        if first is None:
            return
        path = f"{folder}/ids-{uuid.uuid4().hex}.bin"
        head = b"TOKIDS1\0" + np.array([np.dtype(encode.width).itemsize, 0], "<u4").tobytes()
        write_bytes(path, chain([head, first], coming))
        count = np.concatenate(counts)
        key = pa.chunked_array(keys).combine_chunks()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        gone, value = np.asarray(key.is_null()), np.asarray(key.fill_null(0))
        new = np.r_[True, (value[1:] != value[:-1]) | (gone[1:] != gone[:-1])]
        place = np.arange(len(value))
        copy = place - np.maximum.accumulate(np.where(new, place, 0))
        copy = np.where(gone, -1 - copy, copy)
        turn = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * len(count)), pa.array([turn] * len(count), pa.int32()), key, pa.array(copy), pa.array(np.cumsum(count) - count), pa.array(count)],
            ["path", "turn", "doc_id", "copy", "start", "n_ids"],
        )

    ordered = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    written = save(ordered.mapInArrow(write, "path string, turn int, doc_id long, copy long, start long, n_ids long"))
    # one row per file: its number in key order and the ids of all files before it
    files = written.groupBy("path", "turn").agg(F.sum("n_ids").alias("n_ids"), F.count(F.lit(1)).alias("documents"))
    order = Window.orderBy("turn")
    shard_files = save(
        files.select(
            "path", "documents", "n_ids",
            (F.row_number().over(order) - 1).cast("int").alias("shard"),
            F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        )
    )

    def index(key: tuple, group: pa.Table) -> pa.Table:
        value, copy, shard, start, ids = (np.asarray(group.column(x)) for x in ("doc_id", "copy", "shard", "start", "n_ids"))
        path = f"{folder}/index-{uuid.uuid4().hex}.bin"
        write_bytes(path, [build_index(key_hashes(value, copy), shard, start, ids)])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "index_path": [path]})

    parts = max(1, -(-rows // PART_KEYS))
    keyed = written.join(shard_files.select("path", "shard"), "path").withColumn("part", index_part(parts))
    filled = keyed.select("part", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "copy", "shard", "start", "n_ids")
    index_parts = save(filled.groupBy("part").applyInArrow(index, "part int, index_path string"))
    return written.select("doc_id", "copy"), shard_files, index_parts.withColumn("parts", F.lit(parts))


def index_part(parts: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")


def look_up(keys: DataFrame, index_parts: DataFrame) -> DataFrame:
    """Add (shard, start, n_ids) to rows of (doc_id, copy); keys that were never stored get nulls."""
    first = index_parts.select("parts").first()
    if first is None:
        return keys.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("start", "long"), ("n_ids", "long"))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, None
        for batch in batches:
            column = {x: batch.column(k) for k, x in enumerate(batch.schema.names)}
            paths = column.pop("index_path").to_pylist()
            hashes = key_hashes(np.asarray(column["doc_id"].fill_null(0)), np.asarray(column["copy"]))
            records, found = np.zeros(len(hashes), RECORD), np.zeros(len(hashes), bool)
            edges = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for a, b in zip(edges, edges[1:]):
                if a < b and paths[a] is not None:
                    if paths[a] != path:
                        path, held = paths[a], Index(read_bytes(paths[a]))
                    records[a:b], found[a:b] = held.find(hashes[a:b])
            more = {x: pa.array(records[y].astype(t), mask=~found) for x, y, t in (("shard", "shard", np.int32), ("start", "start", np.int64), ("n_ids", "ids", np.int64))}
            yield pa.RecordBatch.from_pydict(column | more)

    # keys of one part meet in one task, so an index file is read once
    dealt = keys.withColumn("part", index_part(first["parts"])).repartition(first["parts"], "part")
    joined = dealt.join(index_parts.drop("parts"), "part", "left").drop("part")
    schema = with_columns(keys.schema, shard="int", start="long", n_ids="long")
    return joined.sortWithinPartitions("index_path").mapInArrow(find, schema)


def read_store(found: DataFrame, shard_files: DataFrame) -> DataFrame:
    """Length and checksum of each looked-up document, from its shard file.

    Every shard's rows are read in file order, a stretch of nearby documents at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_pylist()
            before, start, count = (np.asarray(batch.column(k)).tolist() for k in (2, 3, 4))
            sums, a = [], 0
            while a < len(path):
                b = a + 1
                while b < len(path) and path[b] == path[a] and start[b] >= start[b - 1] and start[b] + count[b] - start[a] <= 1 << 20:
                    b += 1
                ids = read_ids(path[a], start[a], start[b - 1] + count[b - 1] - start[a])
                sums += [zlib.crc32(ids[start[i] - start[a] : start[i] - start[a] + count[i]].astype("<u4").tobytes()) for i in range(a, b)]
                a = b
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.array(before, np.int64) + np.array(start, np.int64)), pa.array(count, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = found.join(shard_files.select("path", "shard", "before"), "shard").select("path", "doc_id", "before", "start", "n_ids")
    rows = rows.repartition(max(1, shard_files.count()), "path")  # a file is read by one task, in order
    return rows.sortWithinPartitions("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write all documents, look every key up in the index and read its ids back."""
    keys, shard_files, index_parts = write_store(docs, working_folder(docs.sparkSession))
    return read_store(look_up(keys, index_parts), shard_files)
