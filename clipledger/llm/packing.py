"""Best-fit packing of documents into sequences by linear grouping.

1. Spark counts the pieces of every length: at most ``capacity`` numbers, whatever
   the corpus, and all that the plan is made from.
2. Lengths above ``capacity / SMALL`` are cut into ``GROUPS`` groups of equal
   cardinality and rounded up to the largest of their group. Few sizes are left, so
   a linear program over whole configurations (columns priced by a knapsack) says
   how many sequences of each configuration to open; fractions are rounded down and
   what remains is placed largest first.
3. Real documents take the places of their group, in order of length, which frees
   the difference to the rounded size; the small ones then go, largest first, into
   the fullest sequence they fit.

The plan is a list of runs: "pieces of length l with rank r .. r+c go to sequences
b, b+1, .., so many each, from this offset on". Spark ranks pieces within their
length in blocks and each piece looks its run up, so no task and no driver holds
the pieces of a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import blocks_for, modest_batches, number_rows, save, with_columns
from clipledger.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
GROUPS = 40
#: Lengths of at most capacity / SMALL are small.
SMALL = 8
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- the plan, from counts of lengths ---------------------------------------


def linear_groups(counts: np.ndarray, smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality, each a list of (length, pieces) from long to short."""
    total = int(counts[smallest + 1 :].sum())
    share, out, room = -(-total // groups) if total else 0, [], 0
    for length in range(len(counts) - 1, smallest, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append([])
                room = share
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable set of sizes that fits, and its counts; one array step per size and place."""
    value, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for j, size in enumerate(sizes):
            gain = value[: capacity + 1 - size] + worth[j]
            more = gain > best[size:] + 1e-12
            best[size:][more] = gain[more]
            pick[size:][more] = j
        value = best
        chosen.append(pick)
    uses, room = [0] * len(sizes), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            uses[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(value[capacity]), uses


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(sequences, pieces of each size in one) of the rounded-down linear program."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    amount = need / basis.diagonal()
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(m))
        value, column = best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(column, float))
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    left, plan = list(demand), []
    for k in range(m):
        uses = [int(round(x)) for x in basis[:, k]]
        times = min([int(amount[k] + 1e-9), *(left[j] // u for j, u in enumerate(uses) if u)])
        if times > 0:
            plan.append((times, uses))
            left = [a - times * u for a, u in zip(left, uses)]
    while any(left):
        uses, room = [0] * m, capacity
        for j in range(m):
            uses[j] = min(left[j], room // sizes[j])
            room -= uses[j] * sizes[j]
        times = min(left[j] // u for j, u in enumerate(uses) if u)
        plan.append((times, uses))
        left = [a - times * u for a, u in zip(left, uses)]
    return plan


class _Gaps:
    """Runs of equally filled sequences by the room they have."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, first: int, n: int, room: int) -> None:
        if n and room:
            if not self.runs[room]:
                bisect.insort(self.rooms, room)
            self.runs[room].append((first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            self.rooms.pop(k)
        return first, n, room


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Runs (length, rank, pieces, first sequence, per sequence, offset) and the number of sequences.

    ``counts[l]`` is the number of pieces of length l, for l up to ``capacity``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    gaps, opened = _Gaps(), int(counts[capacity])
    if opened:
        runs.append((capacity, 0, opened, 0, 1, 0))
    rest = counts.copy()
    rest[capacity] = 0
    smallest = capacity // small
    grouped = linear_groups(rest, smallest, groups)
    waiting = [list(reversed(g)) for g in grouped]
    for times, uses in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity):
        # every place of the configuration takes the next pieces of its group; cut where a length changes
        edges, places = {0, times}, []
        for j, many in enumerate(uses):
            for _ in range(many):
                at, takes = 0, []
                while at < times:
                    length, n = waiting[j].pop()
                    take = min(n, times - at)
                    if n > take:
                        waiting[j].append((length, n - take))
                    takes.append((at, length))
                    at += take
                    edges.add(at)
                places.append(takes)
        cuts = sorted(edges)
        spot = [0] * len(places)
        for a, b in zip(cuts, cuts[1:]):
            filled = 0
            for p, takes in enumerate(places):
                while spot[p] + 1 < len(takes) and takes[spot[p] + 1][0] <= a:
                    spot[p] += 1
                length = takes[spot[p]][1]
                runs.append((length, rank[length], b - a, opened + a, 1, filled))
                rank[length] += b - a
                filled += length
            gaps.put(opened + a, b - a, capacity - filled)
        opened += times
    for length in range(smallest, 0, -1):
        left = int(rest[length])
        while left:
            found = gaps.tightest(length)
            if found is None:
                per = capacity // length
                found = (opened, -(-left // per), capacity)
                opened += found[1]
            first, n, room = found
            per = min(room // length, left)
            full = min(n, left // per)
            runs.append((length, rank[length], full * per, first, per, capacity - room))
            rank[length] += full * per
            left -= full * per
            gaps.put(first, full, room - per * length)
            gaps.put(first + full, n - full, room)
    return np.array(runs, np.int64).reshape(-1, 6), opened


# ---- on Spark -----------------------------------------------------------------


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """One row per piece of every document: its ids' place, number and checksum."""
    modest_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            keys = batch.column(0)
            for first, last, ids, at in encode.column(batch.column(1)):
                own = np.diff(at) + 1
                pieces = -(-own // capacity)
                row = np.repeat(np.arange(last - first), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(own[row] - start, capacity)
                sums = []
                for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()):
                    lo = int(at[r]) + s
                    part = ids[lo : min(lo + n, int(at[r + 1]))].astype("<u4")
                    if len(part) < n:
                        part = np.append(part, np.uint32(end_id))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, last - first).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Pieces of one sequence never overlap and leave no hole before the last one.
    Null keys and repeated rows are packed like any other; no pieces, no rows.
    """
    pieces = save(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    plan, _ = plan_runs(counts, capacity, groups, small)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, see plan_runs
    ranked = number_rows(pieces, "_rank", ["length"], ["doc_id", "piece"], ["doc_id", "piece"], blocks_for(int(counts.sum())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        base = 1 << 44
        keys = runs[:, 0] * base + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("length", "_rank"))
            run = runs[np.searchsorted(keys, length.astype(np.int64) * base + rank, "right") - 1]
            turn = rank - run[:, 1]
            sequence, offset = run[:, 3] + turn // run[:, 4], run[:, 5] + turn % run[:, 4] * length
            names = batch.schema.names
            kept = [batch.column(k) for k, x in enumerate(names) if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [x for x in names if x != "_rank"] + ["sequence_id", "offset"])

    ranked = ranked.select(*pieces.columns, "_rank")
    return ranked.mapInArrow(place, with_columns(pieces.schema, sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of (doc_id, text), packed. A null or empty text is its end id alone."""
    return pack(token_pieces(docs, capacity), capacity)
