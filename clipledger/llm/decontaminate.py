"""Benchmark items that stand in training texts, also in edited form.

1. Words are lower-cased (A-Z) and lose punctuation at their edges. An item of at least
   ``N`` words is known by its pairs of words: neighbours, and those with one word between.
2. The pairs of a training text are looked up. A pair of neighbours in both counts 2, any
   other hit 1, for an alignment's next match costs no error or one.
3. An alignment of M matches scores at most 2 M - 2 (M - 1) + its hits' counts, and ends
   within ``reach`` words of its first match. So only passages whose hits count ``need`` can
   reach the limit, and all of these are aligned with the item by Smith-Waterman over
   words, many passages at a time. How often a pair occurs in the texts plays no part.
4. The likeness is the alignment's score over that of the whole item with itself; from
   ``LIKENESS`` on, the text is contaminated by the item.

Places whose pairs stand in more than ``COMMON`` places of the block aren't looked up, up
to a quarter of what an item needs; ``need`` falls by what they could count, so that
nothing is lost. The benchmark is cut into blocks of at most ``BLOCK`` words, each small
enough to go to all tasks; a larger benchmark takes more passes over the texts, not more
memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import hash_words, lower_bytes, mix, modest_batches, row_starts, runs, slices, with_columns, word_bounds

N, COMMON = 3, 64
MATCH, MISMATCH, GAP = 2, -1, -1
LIKENESS = 0.4
BLOCK = 1 << 20
#: Hits that are looked at together, or those of one text.
ROOM = 1 << 21
_SIEVE = 20
_U = np.uint64
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?\"'()[]{}<>"]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row of a slice, and where each row's begin."""
    starts, ends, _ = word_bounds(data, offsets)
    tail, head = np.flatnonzero(_MARK[data[ends - 1]]), np.flatnonzero(_MARK[data[starts]])
    for _ in range(3):  # at most three marks at either edge go, and a word keeps one character
        tail = tail[_MARK[data[ends[tail] - 1]] & (ends[tail] - starts[tail] > 1)]
        ends[tail] -= 1
        head = head[_MARK[data[starts[head]]] & (ends[head] - starts[head] > 1)]
        starts[head] += 1
    return hash_words(lower_bytes(data), starts, ends), np.searchsorted(starts, offsets)


def pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each word with the one ``apart`` words later; rows' ends are the caller's matter."""
    left = hashes[: max(0, len(hashes) - apart)]
    return mix(left * _U(0xDAA66D2C7DDF743F) + hashes[apart:][: len(left)] * _U(0x18655C4E2AB5A069 | 1))


class Items:
    """A block of benchmark items: their words, and the places of their pairs."""

    def __init__(self, ids: list[int], texts: list[str], likeness: float = LIKENESS):
        if N * likeness <= 1:
            raise ValueError(f"one common word makes a likeness of {likeness}: no pair need be there")
        self.ids, self.words, pair, item, place, near = ids, [], [], [], [], []
        for first, last, data, offsets in slices(pa.array(texts, pa.string())):
            found, begin = words(data, offsets)
            for k in range(last - first):
                own = found[begin[k] : begin[k + 1]]
                self.words.append(own)
                for apart in (1, 2) if len(own) >= N else ():
                    pair.append(pairs(own, apart))
                    item.append(np.full(len(pair[-1]), first + k, np.int32))
                    place.append(np.arange(len(pair[-1]), dtype=np.int32))
                    near.append(np.full(len(pair[-1]), apart == 1))
        # items without a pair of their own: a text is contaminated if it is such an item
        self.short: dict[bytes, list[int]] = {}
        for k, own in enumerate(self.words):
            if 0 < len(own) < N:
                self.short.setdefault(own.tobytes(), []).append(k)
        size = np.array([len(x) for x in self.words], np.int64)
        self.need = np.ceil(MATCH * likeness * size - 2 - 1e-9).astype(np.int64)
        self.reach = np.floor((3 - 2 * likeness) * size + 1e-9).astype(np.int64)
        columns = zip((pair, item, place, near), (np.uint64, np.int32, np.int32, bool))
        self._set(*(np.concatenate(x) if x else np.zeros(0, t) for x, t in columns))

    def _set(self, pair: np.ndarray, item: np.ndarray, place: np.ndarray, near: np.ndarray) -> None:
        _, which, many = np.unique(pair, return_inverse=True, return_counts=True)
        base = row_starts(np.array([len(x) for x in self.words], np.int64))
        often = np.zeros(int(base[-1]), np.int64)  # by place: the more frequent of its two pairs
        at = base[item] + place
        np.maximum.at(often, at, many[which])
        owner = np.repeat(np.arange(len(self.words)), np.diff(base))
        order = np.lexsort((-often, owner))
        rank = np.arange(len(order)) - base[owner[order]]
        left = order[(often[order] > COMMON) & (rank < self.need[owner[order]] // 4)]
        self.need -= 2 * np.bincount(owner[left], minlength=len(self.words))
        kept = np.ones(len(often), bool)
        kept[left] = False
        kept = np.flatnonzero(kept[at])
        order = kept[np.lexsort((place[kept], item[kept], pair[kept]))]
        self.item, self.place, self.near = item[order], place[order], near[order]
        self.keys, self.first, self.many = np.unique(pair[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.keys >> _U(64 - _SIEVE)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the pair, number of the key, neighbours or not) of every known pair of a slice, by row."""
        found = []
        for apart in (1, 2):
            pair = pairs(hashes, apart)
            at = np.flatnonzero(self.sieve[(pair >> _U(64 - _SIEVE)).astype(np.int64)])
            key = np.minimum(np.searchsorted(self.keys, pair[at]), max(0, len(self.keys) - 1))
            good = self.keys[key] == pair[at] if len(self.keys) else np.zeros(0, bool)
            at, key = at[good], key[good]
            row = np.searchsorted(begin, at, "right") - 1
            whole = at + apart < begin[np.minimum(row + 1, len(begin) - 1)]
            found.append((row[whole], at[whole], key[whole], np.full(int(whole.sum()), apart == 1)))
        row, at, key, near = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], at[order], key[order], near[order]


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman over words for many pairs: rows (score, first word, end word) in the passage.

    A cell holds its score above 24 bits that tell where its alignment began, so the
    usual maxima also carry the begin (the earliest of equal scores). Gaps along the
    passage are a running maximum.
    """
    out = np.zeros((len(passages), 3), np.int64)
    order = sorted(range(len(passages)), key=lambda k: (len(passages[k]), len(items[k])))
    low = (1 << 24) - 1
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(passages[order[b]]) <= 1 << 16:
            b += 1
        some = order[a:b]
        width, height = max(len(passages[k]) for k in some), max(len(items[k]) for k in some)
        text, item = np.zeros((len(some), width), np.uint64), np.ones((len(some), height), np.uint64)
        for r, k in enumerate(some):
            text[r, : len(passages[k])], item[r, : len(items[k])] = passages[k], items[k]
        place = np.arange(width, dtype=np.int64)
        fresh = low - place  # an empty alignment that would begin here
        slope = (place * -GAP) << 24
        best, end = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        cell = np.broadcast_to(np.append(fresh, low - width), (len(some), width + 1)).copy()  # by words used of the passage
        for k in range(height):
            gain = np.where(text == item[:, k : k + 1], MATCH << 24, MISMATCH << 24)
            new = np.maximum(np.maximum(cell[:, :-1], fresh) + gain, cell[:, 1:] + (GAP << 24))
            new = np.maximum.accumulate(new + slope, axis=1) - slope
            new = np.where(new >> 24 > 0, new, 0)
            at = new.argmax(1)
            top = np.take_along_axis(new, at[:, None], 1)[:, 0]
            better = top >> 24 > best >> 24
            best, end = np.where(better, top, best), np.where(better, at + 1, end)
            cell[:, 1:] = np.where(new > 0, new, np.append(fresh[1:], low - width))
        out[some] = np.stack([best >> 24, low - (best & low), end], 1)
        out[[k for k, s in zip(some, best >> 24) if s <= 0]] = 0
        a = b
    return out


def passages(items: Items, hashes: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(row, item, places hit, first word, words) of the passages of a slice that can reach the limit."""
    hits = items.hits(hashes, begin)
    sums = row_starts(items.many[hits[2]]) if len(hits[0]) else np.zeros(1, np.int64)
    out, a = [], 0
    while a < len(hits[0]):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + ROOM, "right")) - 1)
        if b < len(hits[0]):  # whole rows only, the first one whatever its size
            begun = int(np.searchsorted(hits[0], hits[0][b]))
            b = begun if begun > a else int(np.searchsorted(hits[0], hits[0][b], "right"))
        out += _passages(items, hashes, begin, *(x[a:b] for x in hits))
        a = b
    return out


def _passages(items: Items, hashes: np.ndarray, begin: np.ndarray, row: np.ndarray, at: np.ndarray, key: np.ndarray, near: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    many = items.many[key]
    spot = runs(items.first[key], many)
    row, at, near = np.repeat(row, many), np.repeat(at, many), np.repeat(near, many) & items.near[spot]
    item, place = items.item[spot].astype(np.int64), items.place[spot]
    order = np.lexsort((~near, at, item, row))
    row, at, item, place, near = row[order], at[order], item[order], place[order], near[order]
    other = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    # a word of the text begins one pair of an alignment at most
    counts = np.where(other | np.r_[True, at[1:] != at[:-1]], 1 + near, 0)
    sums = row_starts(counts)
    reach = items.reach[item]
    line = (np.cumsum(other) - 1) * (len(hashes) + int(reach.max()) + 1) + at
    end = np.searchsorted(line, line + reach, "right")
    first = np.flatnonzero(sums[end] - sums[:-1] >= items.need[item])
    turns = np.bincount(first, minlength=len(row) + 1) - np.bincount(end[first], minlength=len(row) + 1)
    inside = np.flatnonzero(np.cumsum(turns)[:-1] > 0)
    if not len(inside):
        return []
    apart = np.r_[True, (np.diff(inside) > 1) | other[inside[1:]] | (np.diff(at[inside]) > reach[inside[1:]])]
    edges = np.append(np.flatnonzero(apart), len(inside))
    out = []
    for a, b in zip(inside[edges[:-1]].tolist(), (inside[edges[1:] - 1] + 1).tolist()):
        # nor does a word of the item begin more than one
        seeds = len(np.unique(place[a:b]))
        if seeds + len(np.unique(place[a:b][near[a:b]])) >= items.need[item[a]]:
            start, stop, far = int(begin[row[a]]), int(begin[row[a] + 1]), int(reach[a])
            lo, hi = max(start, int(at[a]) - far), min(stop, int(at[b - 1]) + far + N)
            out.append((int(row[a]), int(item[a]), seeds, lo - start, hashes[lo:hi].copy()))
    return out


def contaminations(items: Items, texts: pa.Array, likeness: float) -> list[tuple[int, int, float, int, int, int, int]]:
    """(row, item, likeness, score, seeds, first word, end word) for a column of texts."""
    found, short = [], []
    for first, _, data, offsets in slices(texts):
        hashes, begin = words(data, offsets)
        found += [(first + x[0], *x[1:]) for x in passages(items, hashes, begin)]
        many = np.diff(begin)
        for row in np.flatnonzero((many > 0) & (many < N)).tolist() if items.short else ():
            n = int(many[row])
            whole = items.short.get(hashes[begin[row] : begin[row + 1]].tobytes(), ())
            short += [(first + row, k, 1.0, MATCH * n, 0, 0, n) for k in whole]
    aligned = align([x[4] for x in found], [items.words[x[1]] for x in found]).tolist()
    best: dict[tuple[int, int], tuple] = {}
    for (row, item, seeds, lo, _), (score, first, end) in zip(found, aligned):
        like = score / (MATCH * len(items.words[item]))
        if like >= likeness and (like, seeds) > best.get((row, item), (0, 0))[:2]:
            best[row, item] = (like, score, seeds, lo + first, lo + end)
    return sorted([(*pair, *rest) for pair, rest in best.items()] + short)


def item_blocks(benchmark: DataFrame, likeness: float = LIKENESS, block: int = BLOCK) -> Iterator[Items]:
    """Items in blocks of at most ``block`` words, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for x in rows.orderBy("item_id", "text").toLocalIterator():
        n = x.text.count(" ") + 1
        if ids and size + n > block:
            yield Items(ids, texts, likeness)
            ids, texts, size = [], [], 0
        ids.append(x.item_id)
        texts.append(x.text)
        size += n
    yield Items(ids, texts, likeness)


def _matches(docs: DataFrame, items: Items, likeness: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK words, two pairs each

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = contaminations(known, batch.column(1), likeness)
            at, item, like, score, hits, begin, end = zip(*rows) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array([known.ids[k] for k in item], pa.int64()), pa.array(like, pa.float64()),
                    pa.array(score, pa.int64()), pa.array(hits, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                ],
                ["doc_id", "item_id", "likeness", "score", "seeds", "first_word", "end_word"],
            )

    schema = with_columns(docs.select("doc_id").schema, item_id="long", likeness="double", score="long", seeds="long", first_word="long", end_word="long")
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, likeness: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """One row per (doc_id, item_id) whose best alignment reaches ``likeness``.

    Word places count from 0 in the document, the end is exclusive. Null texts match
    nothing; an item of fewer than N words matches texts of just these words; repeated
    items and rows each give their own rows; an empty table gives none.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = None
    for items in item_blocks(benchmark, likeness, block):
        part = _matches(docs, items, likeness)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, likeness: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """The documents without any contamination, by one pass per block and no shuffle; columns stay."""
    modest_batches(docs.sparkSession)
    names = docs.columns
    for items in item_blocks(benchmark, likeness, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in contaminations(shared.value, batch.column(names.index("text")), likeness)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
