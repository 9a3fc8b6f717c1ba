"""Hard negatives of anchors: a secondary sort of scores, read as a stream that opens windows.

Rows and anchors meet in cells (a group of rows, a chunk of anchors): the chunk stands at
the head of the cell's sorted stream, packed blocks of rows pass by, and one matrix product
scores a block. What a cell sends on is packed into keys of

    anchor, descending score, kind (positives first), id

which are dealt by anchor and sorted within partitions. An iterator then reads each
anchor's scores from the top down, opens a window per positive and emits the negatives that
fall into open windows. It holds the open windows only, however many rows an anchor has.

Cells send no more than can be in the result: in the first pass their best positives; in
the second, once each anchor's positives are known, the first negatives of each window.

Defined cases: rows with a null key or label, or a vector that ``matrix`` leaves out, take no
part. Of rows that share a key one stays, the least by label and vector. Anchors without a
positive, and positives without a fitting negative, give no row; an empty table gives none.
Scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import modest_batches, save
from clipledger.llm.vectors import dimension, matrix, packed, unpacked

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Rows of a group and anchors of a chunk, about; cells at least; rows of a packed block; anchors of one product.
GROUP, CHUNK, GROUPS, BLOCK, TILE = 65_536, 65_536, 16, 2_048, 1_024
_NONE = np.iinfo(np.int64).min
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---- keys ------------------------------------------------------------------------


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Binary keys whose byte order is (anchor, falling score, kind, id)."""
    out = np.empty(len(anchor), _KEY)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    out["kind"], out["id"] = kind, ids.astype(np.int64).view(np.uint64) ^ _SIGN
    offsets = np.arange(len(out) + 1, dtype=np.int32) * _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])


def unpack_keys(column: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    """(anchors, scores, kinds, ids) of packed keys."""
    raw = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    anchor = (raw["anchor"].astype(np.uint64) ^ _SIGN).view(np.int64)
    score = (~raw["score"].astype(np.uint64) ^ _SIGN).view(np.int64)
    return anchor.tolist(), score.tolist(), raw["kind"].tolist(), (raw["id"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives."""
    return -(-low * score // 100), high * score // 100


def sort_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's keys in one partition, partitions in order of the key."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def first_positives(keys: DataFrame, positives: int) -> DataFrame:
    """(anchor, positive_id, positive_score): the first of every anchor's sorted stream."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            out = []
            for anchor, score, _, key in zip(*unpack_keys(batch.column(1))):
                if anchor != now:
                    now, seen = anchor, 0
                seen += 1
                if seen <= positives:
                    out.append((anchor, key, score))
            yield _rows(out, ["anchor", "positive_id", "positive_score"])

    return sort_keys(keys).select("anchor", "key").mapInArrow(take, "anchor long, positive_id long, positive_score long")


def open_windows(keys: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The result, from every anchor's sorted stream of positives and negatives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, score, kind, key in zip(*unpack_keys(batch.column(1))):
                if anchor != now:
                    now, windows = anchor, []
                if kind == 0:
                    windows.append([key, score, *window(score, low, high), 0])
                    continue
                for own in windows:
                    if own[2] <= score <= own[3]:
                        own[4] += 1
                        out.append((anchor, own[0], own[4], key, own[1], score))
                # a window closes when it is full or the scores have fallen below it
                windows = [x for x in windows if x[4] < negatives and x[2] <= score]
            yield _rows(out, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return sort_keys(keys).select("anchor", "key").mapInArrow(read, RESULT)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if name == "rank" else pa.int64()) for x, name in zip(columns, names)], names)


# ---- cells ------------------------------------------------------------------------


def clean_rows(vectors: DataFrame, scale: int, column: str) -> tuple[DataFrame, int]:
    """((vec_id, label, x) with one row per key, dimension); x is the packed vector of integers."""
    width = dimension(vectors, column)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(2), width, scale)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed(x), pa.binary())], ["vec_id", "label", "x"])

    known = vectors.where("vec_id is not null and label is not null")
    rows = known.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), column).mapInArrow(pack, "vec_id long, label long, x binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_r")).select("vec_id", "_r.label", "_r.x"), width


def _narrow(x: np.ndarray) -> bytes:
    """A matrix in the narrowest width that holds it, behind eight bytes that tell the width."""
    size = int(np.abs(x).max(initial=0))
    width = 2 if size < 1 << 15 else 4 if size < 1 << 31 else 8
    return bytes([width] * 8) + x.astype(f"<i{width}").tobytes()


def _wide_rows(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=8).reshape(-1, width).astype(np.int64)


def pieces(rows: DataFrame, width: int, size: int, parts: int, scores: int) -> DataFrame:
    """(block, part, ids, labels, xs, scores): packed rows, up to ``size`` of a part together.

    A row is (vec_id, label, x, scores), with up to ``scores`` scores; its part is a hash of
    its key. Within a piece rows are in order of the key.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, waiting = TaskContext.get().partitionId() << 32, {}
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((name, pa.binary()) for name in ("ids", "labels", "xs", "scores"))])

        def piece(part: int) -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            ids, labels, x, told = (np.concatenate(y) for y in zip(*waiting.pop(part)))
            order = np.argsort(ids, kind="stable")
            row = {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "xs": _narrow(x[order]), "scores": told[order].tobytes()}
            return pa.RecordBatch.from_pylist([{"block": turn, "part": part} | row], schema)

        for batch in batches:
            ids, labels, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
            x, told = unpacked(batch.column(2), width), np.full((len(ids), scores), _NONE)
            for k, own in enumerate(batch.column(3).to_pylist() if scores else ()):
                told[k, : len(own)] = own
            for k in np.unique(part).tolist():
                own = part == k
                waiting.setdefault(k, []).append((ids[own], labels[own], x[own], told[own]))
                if sum(len(y[0]) for y in waiting[k]) >= size:
                    yield piece(k)
        for k in list(waiting):
            yield piece(k)

    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    given = F.col("scores") if scores else F.array().cast("array<long>").alias("scores")
    return rows.select("vec_id", "label", "x", given, part).mapInArrow(pack, "block long, part int, ids binary, labels binary, xs binary, scores binary")


class Best:
    """The first ``k`` rows of each anchor by falling score and id, of all that were offered."""

    def __init__(self, anchors: int, k: int):
        self.score, self.id = np.full((anchors, k), _NONE), np.zeros((anchors, k), np.int64)

    def offer(self, first: int, score: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some anchors, from ``first`` on, with rows of rising ``ids``."""
        have = self.score[first : first + len(score)]
        ok = ok & (score >= have[:, -1:])
        rows = np.flatnonzero(ok.any(1))
        if not len(rows):
            return
        score, ok = score[rows], ok[rows]
        many, k = score.shape[1], min(have.shape[1], score.shape[1])
        place = np.arange(many)
        if int(np.abs(score).max()) < 1 << 40 and many < 1 << 20:
            pick = np.argpartition(np.where(ok, (score << 20) - place, _NONE), many - k, axis=1)[:, many - k :]
        else:
            pick = np.lexsort((np.broadcast_to(place, score.shape), np.where(ok, ~score, ~_NONE)))[:, :k]
        new = np.where(np.take_along_axis(ok, pick, 1), np.take_along_axis(score, pick, 1), _NONE)
        score, ids = np.hstack([have[rows], new]), np.hstack([self.id[first + rows], ids[pick]])
        order = np.lexsort((ids, ~score))[:, : have.shape[1]]
        self.score[first + rows] = np.take_along_axis(score, order, 1)
        self.id[first + rows] = np.take_along_axis(ids, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exactly, as longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors don't fit a long")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Cell:
    """A chunk of anchors and what the blocks of rows that have passed by tell about it."""

    def __init__(self, heads: list[tuple], width: int, scores: int, keep: int, low: int, high: int):
        self.ids, self.labels = (np.concatenate([np.frombuffer(x[k], np.int64) for x in heads]) for k in (0, 1))
        self.x, self.width = np.concatenate([_wide_rows(x[2], width) for x in heads]), width
        told = np.concatenate([np.frombuffer(x[3], np.int64) for x in heads]).reshape(-1, max(1, scores))
        # without scores, the first rows of the same label are wanted; with them, the first others of each window
        self.windows = [None] if not scores else [np.array([window(p, low, high) if p != _NONE else (1, 0) for p in column.tolist()], np.int64) for column in told.T]
        self.best = [Best(len(self.ids), keep) for _ in self.windows]

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        for first in range(0, len(self.ids), TILE):
            own = slice(first, first + TILE)
            score = products(self.x[own], x)
            same = self.labels[own, None] == labels
            for best, bounds in zip(self.best, self.windows):
                if bounds is None:
                    ok = same & (self.ids[own, None] != ids)
                else:
                    ok = ~same & (score >= bounds[own, :1]) & (score <= bounds[own, 1:])
                best.offer(first, score, ok, ids)

    def keys(self, kind: int) -> pa.RecordBatch:
        found = [np.nonzero(x.score != _NONE) for x in self.best]
        at = np.concatenate([x[0] for x in found])
        score, ids = (np.concatenate([part[x] for part, x in zip(y, found)]) for y in ([b.score for b in self.best], [b.id for b in self.best]))
        order = np.lexsort((ids, at))
        at, score, ids = at[order], score[order], ids[order]
        once = np.ones(len(at), bool)  # windows of an anchor may share a negative
        once[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])
        anchor = self.ids[at[once]]
        return pa.RecordBatch.from_arrays([pa.array(anchor), pack_keys(anchor, score[once], kind, ids[once])], ["anchor", "key"])


def best_keys(anchors: DataFrame, rows: DataFrame, width: int, scores: int, keep: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor, key) of all that a cell can't rule out.

    Without ``scores`` the ``keep`` first rows of the anchor's label; with them the ``keep``
    first rows of another label in the window of each of the anchor's scores.
    """
    groups, chunks = (max(least, -(-df.count() // size)) for df, least, size in ((rows, GROUPS, GROUP), (anchors, 1, CHUNK)))
    heads = pieces(anchors, width, TILE, chunks, scores).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = pieces(rows, width, BLOCK, 1, 0).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    cell = (F.col("group").cast("long") * chunks + F.col("part")).alias("cell")
    columns = ["ids", "labels", "xs", "scores"]
    both = heads.select(cell, F.lit(0).alias("kind"), *columns).unionByName(blocks.select(cell, F.lit(1).alias("kind"), *columns))
    dealt = both.repartition(groups * chunks, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            for here, kind, *raw in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if here != now:
                    if held:
                        yield held.keys(1 if scores else 0)
                    now, waiting, held = here, [], None
                if kind == 0:
                    waiting.append(raw)
                    continue
                if held is None and waiting:
                    held, waiting = Cell(waiting, width, scores, keep, low, high), []
                if held:
                    held.add(np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), _wide_rows(raw[2], width))
        if held:
            yield held.keys(1 if scores else 0)

    return dealt.mapInArrow(run, "anchor long, key binary")


# ---- the operator --------------------------------------------------------------------


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, column: str = "embedding") -> DataFrame:
    """Hard negatives of the rows of (vec_id, label, vector) for which ``is_anchor`` holds.

    A score is the inner product of floor(scale * entry). An anchor's positives are the first
    ``positives`` other rows of its label, by falling score and key; per positive the first
    ``negatives`` rows of another label come out whose score is ``low`` to ``high`` hundredths of its.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    rows, width = clean_rows(vectors, scale, column)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = save(rows)
    anchors = rows.where(is_anchor)
    found = save(first_positives(best_keys(anchors, rows, width, 0, positives), positives))
    told = found.groupBy("anchor").agg(F.sort_array(F.collect_list("positive_score"), False).alias("scores"))  # at most ``positives`` each
    ready = save(anchors.join(told.withColumnRenamed("anchor", "vec_id"), "vec_id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, ids, score = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pack_keys(anchor, score, 0, ids)], ["anchor", "key"])

    opened = found.select("anchor", "positive_id", "positive_score").mapInArrow(pack, "anchor long, key binary")
    return open_windows(opened.unionByName(best_keys(ready, rows, width, positives, negatives, low, high)), negatives, low, high)


def mine_embeddings(vectors: DataFrame) -> DataFrame:
    """Anchors are keys divisible by 50; labels of keys divisible by 7 move on by one of ten first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
