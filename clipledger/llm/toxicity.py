"""Toxicity of whole texts: a linear classifier over character n-grams with naive Bayes weights.

1. Every labelled training text gives the set of its n-grams (4 to 7 characters of
   the lower-cased text, hashed to 2^20 numbers). Tasks count, per n-gram and class,
   the texts that hold it; sums of these counts over *all* labelled texts give each
   n-gram's log-count ratio r (toxic over clean rate, smoothed) and the gain of its evidence.
2. The ``FEATURES`` strongest n-grams are features of their own; a text's value for one
   is its r where the n-gram occurs, else 0. All other n-grams of the labelled texts
   make two more features, the sums of their positive and of their negative ratios over
   the root of the text's number of n-grams. Texts are counted in two halves (by a hash of
   the key), and a text of the fit takes these ratios from the half that it isn't in,
   whatever its label; a new text takes the mean of both halves.
3. A logistic regression with ridge penalty is fitted on these values over a bounded
   sample of labelled texts (``FIT_ROWS``, those with the smallest hash of the key). The
   weights of the two sums can't be negative, so evidence keeps its direction; a fit on one
   half, tried on the other, decides whether the sums are used at all.

The model is a few tables of fixed size, so scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import fold, modest_batches, strings, with_columns

ORDERS = (4, 5, 6, 7)
BITS = 20
FEATURES = 4096
FIT_ROWS = 20_000
SMOOTH = 1.0
#: Labels of at most so many rows may be broadcast to the texts (16 bytes each).
SMALL_LABELS = 1_000_000
_PARTS = 64


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of all texts, one array per order, and where each text begins.

    Texts are joined by one character 0; places whose n-gram would leave its text
    hold 2^BITS, which is no n-gram.
    """
    low = [x.lower() for x in texts]
    joined = ("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(joined, "<u4") * np.uint32(2654435761) + np.uint32(0x9E3779B9)
    begin = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in low], out=begin[1:])
    out, rolled = [], code
    for n in range(2, max(ORDERS) + 1):
        rolled = (rolled[:-1] * np.uint32(0x85EBCA6B)) ^ (rolled[:-1] >> np.uint32(15))
        rolled += code[n - 1 :]
        if n in ORDERS:
            found = np.full(len(code), 1 << BITS, np.uint32)
            found[: len(rolled)] = ((rolled ^ np.uint32(n)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            ends = (begin[1:, None] - np.arange(1, n + 1)).ravel()
            found[ends[ends >= 0]] = 1 << BITS
            out.append(found)
    return out, begin


def chunks(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield first, k
            first, size = k, 0
        size += len(x)
    if first < len(texts):
        yield first, len(texts)


def half(key: str = "doc_id") -> Column:
    """0 or 1: the half in which a key's text is counted; a null key is in half 0."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("half")), F.lit(2)).cast("int")


def count_grams(labelled: DataFrame) -> DataFrame:
    """(half, part, texts with each n-gram of that part by class) over rows of (text, toxic, half)."""
    wide = (1 << BITS) // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 2, (1 << BITS) + 1), np.int32)
        last = np.zeros((1 << BITS) + 1, np.int32)
        rows = np.zeros((2, 2), np.int64)
        for batch in batches:
            texts, toxic, side = strings(batch, "text"), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                found, begin = grams(texts[a:b])
                for k in range(b - a):
                    own = np.concatenate([x[begin[k] : begin[k + 1]] for x in found])
                    last[own] = np.arange(len(own), dtype=np.int32)
                    once = own[last[own] == np.arange(len(own))]
                    totals[side[a + k], toxic[a + k]][once] += 1
                    rows[side[a + k], toxic[a + k]] += 1
        for side in np.flatnonzero(rows.sum(1)).tolist():
            for part in range(_PARTS):
                cut = totals[side, :, part * wide : (part + 1) * wide].ravel()
                at = np.flatnonzero(cut)
                clean, toxic = rows[side].tolist() if not part else (0, 0)
                kind = np.min_scalar_type(int(cut.max()))  # the narrowest that holds the counts
                row = {"half": side, "part": part, "place": at.astype("<u2").tobytes(), "counts": cut[at].astype(kind).tobytes(), "clean": clean, "toxic": toxic}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("half", pa.int32()), ("part", pa.int32()), ("place", pa.binary()), ("counts", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int"), F.col("half").cast("int"))
    return rows.mapInArrow(count, "half int, part int, place binary, counts binary, clean long, toxic long")


def likelihood_gain(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How much better two rates of an n-gram explain its texts than one rate does (G statistic)."""
    share, held = toxic / max(1, toxic + clean), in_toxic + in_clean
    gain = np.zeros(len(held))
    for seen, expected in (
        (in_toxic, held * share), (in_clean, held * (1 - share)),
        (toxic - in_toxic, (toxic + clean - held) * share), (clean - in_clean, (toxic + clean - held) * (1 - share)),
    ):
        gain += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * gain


def total_counts(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(texts with each n-gram by half, clean and toxic; texts of each half and class): 4 * 2^BITS numbers, whatever the corpus."""
    wide = (1 << BITS) // _PARTS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(2 * wide, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            place, counts, clean, toxic = (batch.column(batch.schema.get_field_index(x)) for x in ("place", "counts", "clean", "toxic"))
            for at, n in zip(place, counts):
                at = np.frombuffer(at.as_buffer(), "<u2")
                if len(at):
                    total[at] += np.frombuffer(n.as_buffer(), f"<u{n.as_buffer().size // len(at)}")
            rows += [sum(clean.to_pylist()), sum(toxic.to_pylist())]
        yield pa.RecordBatch.from_pydict({"half": [key[0].as_py()], "part": [key[1].as_py()], "counts": [total.tobytes()], "clean": rows[:1], "toxic": rows[1:]}, added)

    added = pa.schema([("half", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())])
    out, texts = np.zeros((2, 2, 1 << BITS), np.int64), np.zeros((2, 2), np.int64)
    for side, part, raw, *n in counted.groupBy("half", "part").applyInArrow(add, "half int, part int, counts binary, clean long, toxic long").collect():
        out[side, :, part * wide : (part + 1) * wide] = np.frombuffer(raw, np.int64).reshape(2, wide)
        texts[side] += n
    return out, texts


def log_ratios(total: np.ndarray, clean: int, toxic: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams with the strongest evidence and their ratios."""
    p, q = (total[1] + SMOOTH) / (toxic + 2 * SMOOTH), (total[0] + SMOOTH) / (clean + 2 * SMOOTH)
    strength = likelihood_gain(total[1], total[0], toxic, clean)
    seen = np.flatnonzero(total.sum(0))
    best = seen[np.argsort(-strength[seen], kind="stable")][:features]
    return best, np.log(p[best]) - np.log(q[best])


def rest_ratios(total: np.ndarray, clean: int, toxic: int, gram: np.ndarray) -> np.ndarray:
    """Ratio of every n-gram that isn't in ``gram``, 0 for unseen ones."""
    rate = SMOOTH / max(1, clean + toxic)
    out = np.append(np.log(total[1] / max(1, toxic) + rate) - np.log(total[0] / max(1, clean) + rate), 0.0).astype(np.float32)
    out[:-1][total.sum(0) == 0] = 0
    out[gram] = 0
    return out


class Model:
    """Features, their ratios, weights and the bias, and the ratios of all other n-grams; a bounded size whatever the corpus."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray, rest: np.ndarray):
        self.gram, self.ratio, self.weight, self.bias = gram, ratio, np.zeros(len(gram)), 0.0
        self.rest, self.rest_weight = rest, np.zeros(2)
        self.number = np.full((1 << BITS) + 1, -1, np.int32)
        self.number[gram] = np.arange(len(gram))
        self.known = self.number >= 0

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, in order of text."""
        rows, cols = [], []
        for a, b in chunks(texts):
            found, begin = grams(texts[a:b])
            hits = [np.flatnonzero(self.known[x]) for x in found]
            at = np.concatenate(hits)
            row = np.searchsorted(begin, at, "right") - 1
            pair = np.unique(row * len(self.gram) + np.concatenate([self.number[x[h]] for x, h in zip(found, hits)])) if len(at) else np.zeros(0, np.int64)
            rows.append(pair // max(1, len(self.gram)) + a)
            cols.append(pair % max(1, len(self.gram)))
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def sums(self, texts: list[str], tables: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """(positive sum, negative sum) of each text's own table over its n-grams, each once, by the root of their number."""
        out, last = np.zeros((len(texts), 2)), np.zeros((1 << BITS) + 1, np.int32)
        for a, b in chunks(texts):
            found, begin = grams(texts[a:b])
            for k in range(b - a):
                own = np.concatenate([x[begin[k] : begin[k + 1]] for x in found])
                place = np.arange(len(own), dtype=np.int32)
                last[own] = place
                once = own[last[own] == place]
                value = tables[which[a + k]][once]
                total, size = float(value.sum(dtype=float)), float(np.abs(value).sum(dtype=float))
                out[a + k] = (size + total) / 2, (total - size) / 2
                out[a + k] /= np.sqrt(len(once))
        return out

    def fit(self, rows: np.ndarray, cols: np.ndarray, rest: np.ndarray, labels: np.ndarray, with_sums: bool = True, steps: int = 500, ridge: float = 1e-5) -> None:
        """Full-batch accelerated gradient steps of ridge-penalised logistic regression."""
        n = len(labels)
        value, known = self.ratio[cols], len(self.gram)
        positive = (labels.sum() + 0.5) / (n + 2.0)
        self.bias = float(np.log(positive / (1 - positive)))
        if not n:
            return
        # the two sums get the size of the features, so that steps suit both
        size = np.sqrt((rest**2).mean(0)) * with_sums
        scale = np.where(size > 0, np.sqrt(np.bincount(rows, value**2, n).mean() or 1.0) / np.where(size > 0, size, 1), 0)
        rows, cols = np.concatenate([rows, np.tile(np.arange(n), 2)]), np.concatenate([cols, np.repeat([known, known + 1], n)])
        value = np.concatenate([value, (rest * scale).T.ravel()])
        bound = 0.25 * np.bincount(rows, value**2, n).mean() * 2 + 0.25 + ridge
        w = v = np.zeros(known + 2)
        b = c = self.bias
        for step in range(steps):
            margin = np.bincount(rows, value * v[cols], n) + c
            error = 1 / (1 + np.exp(-margin)) - labels
            slope = np.bincount(cols, value * error[rows], len(w)) / n + ridge * v
            next_w, next_b = v - slope / bound, c - error.mean() / bound
            next_w[known:] = np.maximum(next_w[known:], 0)
            momentum = step / (step + 3)
            v, c = next_w + momentum * (next_w - w), next_b + momentum * (next_b - b)
            w, b = next_w, next_b
        self.weight, self.rest_weight, self.bias = w[:known] * self.ratio, w[known:] * scale, float(b)

    def margins(self, rows: np.ndarray, cols: np.ndarray, rest: np.ndarray) -> np.ndarray:
        own = np.bincount(rows, self.weight[cols], len(rest)) if len(cols) else np.zeros(len(rest))
        return own + rest @ self.rest_weight + self.bias

    def sums_help(self, rows: np.ndarray, cols: np.ndarray, rest: np.ndarray, labels: np.ndarray, side: np.ndarray) -> bool:
        """Whether a fit on half 0 explains half 1 better with the sums, and finds as many toxic texts there."""
        learn, told = side == 0, []
        number = np.cumsum(learn) - 1
        mine = learn[rows]
        for with_sums in (False, True):
            self.fit(number[rows[mine]], cols[mine], rest[learn], labels[learn], with_sums)
            margin, truth = self.margins(rows, cols, rest)[~learn], labels[~learn]
            told.append((np.logaddexp(0, np.where(truth > 0, -margin, margin)).sum(), int(((margin >= 0) & (truth > 0)).sum())))
        (loss, found), (loss_with, found_with) = told
        return loss_with < loss and found_with >= found

    def score(self, texts: list[str]) -> np.ndarray:
        rest = self.sums(texts, [self.rest], np.zeros(len(texts), int)) if self.rest_weight.any() else np.zeros((len(texts), 2))
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.features(texts), rest), -40, 40)))


def train(docs: DataFrame, labels: DataFrame, keep: Column, features: int = FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` for which ``keep`` holds.

    Labels other than 0 and 1, and those without a text, are left out; a key with
    several labels counts as toxic if one of them says so. Without any usable label
    the model knows no n-gram and gives every text 0.25.
    """
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= SMALL_LABELS:
        labels = F.broadcast(labels)
    labelled = docs.where(keep).select("doc_id", "text").join(labels, "doc_id").withColumn("half", half())
    total, texts = total_counts(count_grams(labelled))
    clean, toxic = texts.sum(0).tolist()
    gram, ratio = log_ratios(total.sum(0), clean, toxic, features)
    halves = [rest_ratios(total[k], *texts[k].tolist(), gram) for k in (0, 1)]
    model = Model(gram, ratio, (halves[0] + halves[1]) / 2)
    share = min(1.0, fit_rows / max(1, clean + toxic))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    empty = spark.sparkContext.broadcast((model, halves))  # bounded by FEATURES and 2^BITS

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, apart = empty.value
        for batch in batches:
            texts = strings(batch, "text")
            rows, cols = known.features(texts)
            rest = known.sums(texts, apart, 1 - batch.column(2).to_numpy(zero_copy_only=False))
            at = np.searchsorted(rows, np.arange(len(texts) + 1)).tolist()
            cols = cols.astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([cols[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array(rest[:, 0]), pa.array(rest[:, 1])],
                ["toxic", "half", "cols", "up", "down"],
            )

    rows = sample.select("text", "toxic", "half").mapInArrow(extract, "toxic int, half int, cols binary, up double, down double").collect()  # at most about fit_rows
    empty.destroy()
    parts = [np.frombuffer(x.cols, "<u2").astype(np.int64) for x in rows]
    row, col = np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate([np.zeros(0, np.int64), *parts])
    rest = np.array([(x.up, x.down) for x in rows], float).reshape(-1, 2)
    truth, side = np.array([x.toxic for x in rows], float), np.array([x.half for x in rows], int)
    model.fit(row, col, rest, truth, model.sums_help(row, col, rest, truth, side))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to rows with a ``text``; a null text counts as ''."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and 2^BITS
    names = [x for x in docs.columns if x not in ("score", "predicted")]
    docs = docs.select(*names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.score(strings(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(rate, with_columns(docs.schema, score="double", predicted="int"))


def held_out(key: str = "doc_id") -> Column:
    return fold(key, 5) == 0
