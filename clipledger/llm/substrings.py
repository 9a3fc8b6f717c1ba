"""Repeated passages: every word that a window of 20 words covers which also starts earlier.

1. *Candidates.* Of the phrases of 7 words in a window, the one with the least hash is its
   anchor; equal windows have equal anchors at equal places. Tasks count anchors, Spark adds
   the counts up, and phrases that occur at least twice are marked in a table of 2^28 bits
   (a fixed size; a mark too many only costs work).
2. *Automata.* Each shard of documents (a slice of about 1 MB) compiles an Aho-Corasick
   automaton of the marked phrases that it holds and streams its texts through it, which
   finds every occurrence, letter by letter. Windows whose anchor is found are candidates.
   A dictionary of all phrases would grow with the corpus, and every text would have to pass
   all of its shards; so the automata are sharded with the texts that they search.
3. *First places.* Candidate windows meet by a hash of their 20 words (64 bits, besides the
   block's): the smallest (document, place) is the first, all others are repeats. A batch
   sends a window once, as the first of its own, so no window brings more entries to a task
   than there are batches.
4. Repeats go back to their batch and become covered ranges of words per text, and a last
   pass over the texts drops these words.

Defined cases: null and empty texts have no words; a null key is smaller than all others and
rows of one key are one document, so equal rows lose the same words and neither is earlier.
Texts of fewer than 20 words keep everything. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import hash_words, mix, modest_batches, row_starts, runs, save, slices, word_bounds

WINDOW, PHRASE = 20, 7
#: Bits of the table of repeated phrases, in so many parts.
MARKS, PARTS = 28, 1024
#: Bytes of a shard of texts, candidate windows of a batch and, about, of a block.
SHARD, BATCH, BLOCK = 1 << 20, 1 << 19, 1 << 21
_U = np.uint64
_FACTORS = mix(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_ENTRY = np.dtype([("hash", "<u8"), ("row", "<u4"), ("start", "<u4")])
_RANGE = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])


# ---- words of a shard ----------------------------------------------------------------


class Shard:
    """The words of some texts, the hashes of their runs, and the anchors of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.many = word_bounds(data, offsets)
        self.first = row_starts(self.many)

    def index(self) -> Shard:
        """Hash the words; place, text and anchor of every window."""
        self.word = hash_words(self.data, self.starts, self.ends)
        size = max(0, len(self.word) - WINDOW + 1)
        row = np.repeat(np.arange(len(self.many)), self.many)[:size]
        at = np.arange(size)
        self.at = at[at + WINDOW <= self.first[row + 1]]
        self.row = row[self.at]
        self.phrases = self.runs_of(PHRASE, _FACTORS)
        # the leftmost least phrase of each window
        inner = sliding_window_view(self.phrases, WINDOW - PHRASE + 1)[self.at] if size else np.zeros((0, 1), np.uint64)
        self.anchor = self.at + inner.argmin(1)
        return self

    def runs_of(self, n: int, factors: np.ndarray) -> np.ndarray:
        """A hash of every n words in a row, across texts too."""
        total = np.zeros(max(0, len(self.word) - n + 1), np.uint64)
        for k in range(n):
            total += self.word[k : k + len(total)] * factors[k]
        return mix(total)

    def located(self, marks: np.ndarray) -> np.ndarray:
        """Whether a marked phrase begins at each word, by an automaton of those that are anchors."""
        import ahocorasick

        out = np.zeros(len(self.word), bool)
        anchors = np.unique(self.anchor)
        spot = (self.phrases[anchors] >> _U(64 - MARKS)).astype(np.int64)
        anchors = anchors[(marks[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0]
        if not len(anchors):
            return out
        text, place = self.spaced()
        size = self.ends - self.starts
        last = anchors + PHRASE - 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for a, b in zip(place[anchors].tolist(), (place[last] + size[last] + 2).tolist()):
            automaton.add_word(text[a:b], b - a)
        automaton.make_automaton()
        found = np.array([end - length + 1 for end, length in automaton.iter(text)], np.int64)
        out[np.searchsorted(place, found)] = True
        return out

    def spaced(self) -> tuple[str, np.ndarray]:
        """The texts with one space before and after each word and a line break between texts, a letter
        per byte, and where each word's space is."""
        size = self.ends - self.starts
        row = np.repeat(np.arange(len(self.many)), self.many)
        place = row_starts(size + 1)[:-1] + 2 * row
        out = np.full(int(size.sum()) + len(size) + 2 * len(self.many), 0x20, np.uint8)
        breaks = row_starts(np.bincount(row, size + 1, len(self.many)).astype(np.int64) + 2)[1:] - 1
        out[breaks] = 0x0A
        out[runs(place + 1, size)] = self.data[runs(self.starts, size)]
        return out.tobytes().decode("latin-1"), place


# ---- which phrases repeat ----------------------------------------------------------------


def repeated_phrases(docs: DataFrame) -> DataFrame:
    """(phrase) of anchors that occur at two places and more, over rows of (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SHARD):
                shard = Shard(data, offsets).index()
                phrase, n = np.unique(shard.phrases[np.unique(shard.anchor)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(phrase.view(np.int64)), pa.array(n.astype(np.int32))], ["phrase", "n"])

    counted = docs.select("text").mapInArrow(count, "phrase long, n int")
    return counted.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1")


def mark(phrases: DataFrame) -> tuple[np.ndarray, int]:
    """(the table of 2^MARKS bits, occurrences of all phrases in it): a fixed size, whatever the corpus."""
    wide = 1 << MARKS - PARTS.bit_length() + 1

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = np.zeros(wide, bool), 0
        for batch in batches:
            phrase = batch.column(batch.schema.get_field_index("phrase")).to_numpy().view(np.uint64)
            bits[((phrase >> _U(64 - MARKS)) & _U(wide - 1)).astype(np.int64)] = True
            total += int(batch.column(batch.schema.get_field_index("n")).to_numpy().sum())
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()], "n": [total]})

    part = F.shiftrightunsigned("phrase", 64 - PARTS.bit_length() + 1).alias("part")
    out, total = np.zeros((PARTS, wide // 8), np.uint8), 0
    for k, bits, n in phrases.select(part, "phrase", "n").groupBy("part").applyInArrow(fill, "part long, bits binary, n long").collect():
        out[k] = np.frombuffer(bits, np.uint8)
        total += n
    return out.ravel(), total


# ---- candidate windows and first places ------------------------------------------------------


def _first_of(hash_: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, whether each in that order starts at its hash's first place)."""
    order = np.lexsort((start, key, hash_))
    hash_, key, start = hash_[order], key[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = hash_[1:] != hash_[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    return order, (key == key[head]) & (start == start[head])


def candidates(docs: DataFrame, marks: np.ndarray, bits: int) -> tuple[DataFrame, object]:
    """Per batch a row of its texts (block < 0) and rows of its windows per block; and the broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # 2^MARKS bits

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("signs", pa.binary()), ("entries", pa.binary())])
        keys, signs, found, held = [], [], [], 0

        def rows() -> Iterator[dict]:
            key, sign = np.concatenate(keys), np.concatenate(signs)
            block, hash_, row, start = (np.concatenate(x) for x in zip(*found))
            base = key.tobytes()
            order, first = _first_of(hash_, key[row], start)
            gone = order[~first]
            entry = np.zeros(len(order), _ENTRY)
            entry["hash"], entry["row"], entry["start"] = hash_, row, start
            yield {"block": -1 - (turn & ((1 << bits) - 1)), "batch": turn, "keys": base, "signs": sign.tobytes(), "entries": entry[gone].tobytes()}
            order = order[first]
            order = order[np.argsort(block[order], kind="stable")]
            edges = np.searchsorted(block[order], np.arange((1 << bits) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = entry[order[edges[k] : edges[k + 1]]]
                used, number = np.unique(own["row"], return_inverse=True)
                packed = [own["hash"].tobytes(), number.astype("<u4").tobytes(), own["start"].tobytes()]
                yield {"block": k, "batch": turn, "keys": key[used].tobytes(), "signs": used.astype("<u4").tobytes(), "entries": b"".join(packed)}

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            sign = batch.column(1).to_numpy()
            for a, b, data, offsets in slices(batch.column(2), SHARD):
                shard = Shard(data, offsets).index()
                some = shard.located(shared.value)[shard.anchor]
                at, row = shard.at[some], shard.row[some]
                if not len(at):
                    continue
                block = (shard.runs_of(WINDOW, _FACTORS[WINDOW:])[at] & _U((1 << bits) - 1)).astype(np.int64)
                used, number = np.unique(row, return_inverse=True)
                found.append((block, shard.runs_of(WINDOW, _FACTORS)[at], number + sum(map(len, keys)), at - shard.first[row]))
                keys.append(ids[a:b][used])
                signs.append(sign[a:b][used])
                held += len(at)
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(list(rows()), schema)
                    turn, keys, signs, found, held = turn + 1, [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(rows()), schema)

    out = docs.select("doc_id", "sign", "text").mapInArrow(search, "block long, batch long, keys binary, signs binary, entries binary")
    return out, shared


def later_places(found: DataFrame) -> DataFrame:
    """(batch, keys, signs, entries): each batch's texts, and its windows that start earlier elsewhere."""

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "keys", "signs", "entries"]
        if key[0].as_py() < 0:
            for batch in batches:
                yield batch.select(names)
            return
        hashes, ids, row, start, owner, turns = [], [], [], [], [], []
        for batch in batches:
            for turn, keys, used, raw in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names)):
                n = len(raw) // _ENTRY.itemsize
                number = np.frombuffer(raw, "<u4", n, 8 * n)
                hashes.append(np.frombuffer(raw, "<u8", n))
                ids.append(np.frombuffer(keys, np.int64)[number])
                row.append(np.frombuffer(used, "<u4")[number])
                start.append(np.frombuffer(raw, "<u4", n, 12 * n))
                owner.append(np.full(n, len(turns), np.int32))
                turns.append(turn)
        order, first = _first_of(np.concatenate(hashes), np.concatenate(ids), np.concatenate(start))
        gone = order[~first]
        entry = np.zeros(len(gone), _ENTRY)
        entry["row"], entry["start"] = np.concatenate(row)[gone], np.concatenate(start)[gone]
        owner = np.concatenate(owner)[gone]
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(turns) + 1))
        some = np.flatnonzero(np.diff(edges)).tolist()
        packed = [entry[["row", "start"]][by[edges[k] : edges[k + 1]]] for k in some]
        raw = [np.column_stack([x["row"], x["start"]]).astype("<u4").tobytes() for x in packed]
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([turns[k] for k in some], pa.int64()), none, none, pa.array(raw, pa.binary())], names)

    return found.groupBy("block").applyInArrow(compare, "batch long, keys binary, signs binary, entries binary")


def covered_words(later: DataFrame) -> DataFrame:
    """(doc_id, sign, ranges) of texts that lose words: (first word, end) pairs, in order and apart."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sign = None
        rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for keys, signs, raw in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("keys", "signs", "entries"))):
                if keys is not None:
                    ids, sign, own = np.frombuffer(keys, np.int64), np.frombuffer(signs, np.int64), np.frombuffer(raw, _ENTRY)
                    rows.append(own["row"].astype(np.int64))
                    starts.append(own["start"].astype(np.int64))
                else:
                    own = np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.int64)
                    rows.append(own[:, 0])
                    starts.append(own[:, 1])
        row, start = np.concatenate(rows), np.concatenate(starts)
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + WINDOW)
        last = np.append(np.flatnonzero(new)[1:], len(row)) - 1 if len(row) else np.zeros(0, np.int64)
        text, spans = row[new], np.column_stack([start[new], start[last] + WINDOW]).astype("<u4")
        edges = np.searchsorted(text, np.arange(len(ids) + 1))
        some = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(sign[some]), pa.array([spans[edges[k] : edges[k + 1]].tobytes() for k in some.tolist()], pa.binary())], ["doc_id", "sign", "ranges"])

    return later.groupBy("batch").applyInArrow(merge, "doc_id long, sign long, ranges binary")


# ---- the texts without them ---------------------------------------------------------------------


def _keep(shard: Shard, ranges: list[bytes | None]) -> np.ndarray:
    """Whether each word of a shard stays."""
    edge = np.zeros(len(shard.starts) + 1, np.int64)
    for row, raw in enumerate(ranges):
        if raw is not None:
            for a, b in np.frombuffer(raw, "<u4").reshape(-1, 2).tolist():
                edge[shard.first[row] + a] += 1
                edge[shard.first[row] + b] -= 1
    return np.cumsum(edge)[:-1] == 0


def _kept(shard: Shard, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    size = (shard.ends - shard.starts)[keep]
    place = row_starts(size + 1)
    out = np.full(int(place[-1]), 0x20, np.uint8)
    out[runs(place[:-1], size)] = shard.data[runs(shard.starts[keep], size)]
    raw, edge = out.tobytes(), place[row_starts(keep)[shard.first]].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(edge, edge[1:])]


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, sign, ranges) of rows of (doc_id, text, sign) with words to drop; a null key as the least long."""
    repeated = save(repeated_phrases(docs))
    marks, occurrences = mark(repeated)
    # an occurrence anchors up to 14 windows, about half of them
    bits = max(0, (occurrences * (WINDOW - PHRASE) // 2 // BLOCK).bit_length())
    found, shared = candidates(docs, marks, bits)
    # rows that are repeated lose the same words: they are told once
    out = save(covered_words(later_places(found)).dropDuplicates(["doc_id", "sign"]))
    shared.destroy()
    return out


def _signed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sign"))


def drop_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row of (doc_id, text); ``kept`` only if asked for."""
    modest_batches(docs.sparkSession)
    docs = _signed(docs)
    gone = find_repeats(docs).withColumnRenamed("doc_id", "_key")
    key = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))
    joined = docs.withColumn("_key", key).join(gone, ["_key", "sign"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(2).to_pylist()
            for a, b, data, offsets in slices(batch.column(1), SHARD):
                shard = Shard(data, offsets)
                keep = _keep(shard, ranges[a:b])
                kept = _kept(shard, keep)
                stay = np.diff(row_starts(keep)[shard.first])
                columns = [batch.column(0).slice(a, b - a), pa.array(shard.many), pa.array(shard.many - stay), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]
    return joined.select("doc_id", "text", "ranges").mapInArrow(cut, schema)
