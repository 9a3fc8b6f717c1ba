"""Document fingerprints from closed syncmers, and their likeness by place.

A k-mer of characters is a closed syncmer if its smallest s-mer (by hash) is its
first or its last. That depends on the k-mer alone, so equal passages give equal
anchors wherever they stand. A fingerprint keeps all anchors with hashes below ``BOUND``
(a sixteenth of them, about one per 70 characters, however long the text) and the
``ANCHORS`` smallest at least, each with the place of its first occurrence; a text
shorter than k has one anchor, itself.

Two fingerprints are compared over the range of hashes both have in full: anchors of
equal hash are matched, and the longest chain whose places rise in both texts counts.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import mix, strings
from clipledger.llm.toxicity import chunks

#: The steps of ``anchors`` double lengths: s is a power of two, k is s + 8.
K, S = 16, 8
#: Anchors at least, and the hash below which all are kept.
ANCHORS, BOUND = 48, 1 << 28
_U = np.uint64
#: Rows of one sorted stretch of the corpus, and how many stretches there are at most (beyond, they grow).
STRETCH, STRETCHES = 1_000, 1 << 16


def anchors(texts: list[str]) -> list[np.ndarray]:
    """For each text its anchors as rows (hash, place), ordered by hash."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(size) - size
    picked, at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(code) >= K:
        rolled, span, factor = (code + _U(1)) * _U(0x9E3779B97F4A7C15), 1, 0xD6E8FEB86659FD93
        while span < S:
            rolled = rolled[:-span] * _U(factor) + rolled[span:]
            span, factor = 2 * span, factor * factor & (1 << 64) - 1
        value = mix(rolled)
        low, wide = value, 1
        while wide < K - S:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        low = np.minimum(low[:-1], value[wide:])
        closed = (low == value[: len(low)]) | (low == value[wide:])
        at = np.flatnonzero(closed)
        row = np.searchsorted(begin, at, "right") - 1
        at = at[at + K <= begin[row] + size[row]]
        picked = (mix(value[at] * _U(0x9E3779B97F4A7C15) + value[at + K - S]) >> _U(32)).astype(np.uint32)
    edge = np.searchsorted(at, begin)
    edge = np.append(edge, len(at))
    out = []
    for k, text in enumerate(texts):
        mine, place = picked[edge[k] : edge[k + 1]], at[edge[k] : edge[k + 1]] - begin[k]
        if not len(mine) and text:
            mine, place = np.array([int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:4], "little")], np.uint32), np.zeros(1, np.int64)
        room = ANCHORS
        while len(mine) > 4 * room:  # repeated anchors may fill the room: then look further
            bound = max(BOUND, int(np.partition(mine, 2 * room)[2 * room]))
            few = mine <= bound
            if len(np.unique(mine[few])) >= ANCHORS:
                mine, place = mine[few], place[few]
                break
            room *= 2
        value, first = np.unique(mine, return_index=True)
        kept = max(ANCHORS, int(np.searchsorted(value, BOUND)))
        out.append(np.stack([value[:kept], place[first[:kept]].astype(np.uint32)], 1) if len(value) else np.zeros((0, 2), np.uint32))
    return out


def as_text(found: np.ndarray) -> str:
    """Base64 of little-endian pairs (hash, place)."""
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of either text that the two have in the same order; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    bound = min(max(BOUND - 1, int(x[-1, 0])) if len(x) >= ANCHORS else 1 << 32 for x in (a, b))
    a, b = a[a[:, 0] <= bound], b[b[:, 0] <= bound]
    _, left, right = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    ends: list[int] = []
    for place in b[right, 1][np.argsort(a[left, 1], kind="stable")].tolist():
        k = bisect.bisect_left(ends, place)
        ends[k : k + 1] = [place]
    return len(ends) / max(1, len(a) + len(b) - len(ends))


def stretches(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(part, row or donor, doc_id, text): descending stretches, each closed by the row that follows.

    Cuts are keys of the table; the row at a cut also goes to the stretch before it,
    and the very first row to the last stretch, so neighbours never cross tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    parts = min(STRETCHES, max(1, -(-rows // stretch)))
    cuts: list[int] = []
    if parts > 1 and top is not None:
        shares = [k / parts for k in range(1, parts)]
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0]) - {top})
    # part 0 holds the largest keys; a cut is the largest key of its part
    last, limits = len(cuts), np.array(cuts, np.int64)

    @F.pandas_udf("struct<part:int,cut:boolean>")
    def place(key: pd.Series) -> pd.DataFrame:
        value = key.fillna(-(1 << 63)).astype("int64").to_numpy()
        at = np.searchsorted(limits, value)
        held = np.zeros(len(value), bool) if not last else (limits[np.minimum(at, last - 1)] == value) & key.notna().to_numpy()
        return pd.DataFrame({"part": np.where(key.isna(), last, last - at).astype("int32"), "cut": held})

    docs = docs.withColumn("_place", place("doc_id"))
    part, is_cut = F.col("_place.part"), F.col("_place.cut")
    is_top = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
    # no key at all: then everything is one stretch and the first row follows the last
    own = F.array(F.struct(part.alias("part"), F.lit(0).alias("donor")))
    before = F.when(is_cut, F.array(F.struct((part - 1).alias("part"), F.lit(1).alias("donor")))).otherwise(F.array().cast("array<struct<part:int,donor:int>>"))
    around = F.when(is_top, F.array(F.struct(F.lit(last).alias("part"), F.lit(2).alias("donor")))).otherwise(F.array().cast("array<struct<part:int,donor:int>>"))
    dealt = docs.select(F.explode(F.concat(own, before, around)).alias("_x"), "doc_id", "text").select("_x.part", "_x.donor", "doc_id", "text")
    return dealt.repartition(last + 1, "part").sortWithinPartitions("part", "donor", F.desc_nulls_last("doc_id"), F.desc("text"))


def fingerprint_documents(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Fingerprints of (doc_id, text), of each text with its second half replaced, and likenesses.

    The next document is that of the next smaller key, after the last the first;
    rows of one key are ordered by text, descending, null keys come last. A null
    text is ''. The half is replaced by as many characters of the next document, or
    all of them where it is shorter.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, str] | None = None

        def emit(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
            keys = [r[0] for r in rows]
            cut = [len(r[1]) // 2 for r in rows]
            edited = [r[1][: len(r[1]) - n] + r[2][:n] for r, n in zip(rows, cut)]
            own, changed = anchors([r[1] for r in rows]), anchors(edited)
            following = [own[k + 1] if rows[k][2] == rows[k + 1][1] else anchors([rows[k][2]])[0] for k in range(len(rows) - 1)]
            following += anchors([rows[-1][2]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array([as_text(x) for x in own]), pa.array([as_text(x) for x in changed]),
                    pa.array([likeness(x, y) for x, y in zip(own, changed)]), pa.array([likeness(x, y) for x, y in zip(own, following)]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            part, donor, key, text = (batch.column(k).to_pylist() for k in range(4))
            pairs = []
            for p, d, i, x in zip(part, donor, key, text):
                if held is not None and held[0] == p:
                    pairs.append((held[1], held[2], x))
                    held = None
                if not d:
                    held = (p, i, x)
            for a, b in chunks([x[1] for x in pairs]):
                yield emit(pairs[a:b])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return stretches(docs, stretch).mapInArrow(compare, schema)

