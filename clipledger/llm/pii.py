"""Personal data by a skip-chain conditional random field over the words of each document.

Base patterns give certain spans. Words with a digit or an at sign are candidates; they
and their neighbours are the variables of a field with labels none, email, ip, card
and phone:

* own potential: how often words of this shape are inside base spans (all documents
  are counted); words inside a base span are observed; the others start from the
  odds ``LOOSE`` that the patterns missed something of that shape;
* chain potential between words that follow each other;
* skip potential between words of a document that repeat or resemble each other
  (equal without case and edge marks, or the same last digits), each tied to the
  occurrence before it, so a group of n words is a path of n - 1 ties.

Both pair potentials are ratios of joint to independent label counts over all
documents, held within ``CHAIN`` and ``SKIP`` so that messages settle. Loopy sum-product
messages run over the candidates of a whole batch of documents: in each turn whole paths
of ties pass theirs from end to end, and the chains theirs to the next word. A document
is done when none of its messages changes by ``TOLERANCE`` any more (``TURNS`` is only a
guard; from ``CALM`` turns on messages are damped). A word whose belief in a label is over one half is a new span unless
a base span covers it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import modest_batches, strings, with_columns

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SHAPES = 1 << 14
LOOSE, CHAIN, SKIP = 0.05, 4.0, 256.0
TOLERANCE, CALM, TURNS = 1e-4, 30, 1000
#: Pairs of alike words with equal labels that are taken as seen before the first document.
AGREE = 50
_PLAIN = SHAPES
_MARK = re.compile(r"[0-9@]")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number can only begin where no digit stands before it: the words in between were taken or failed as a whole
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'"
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){2,}")
_PIECE = re.compile(r"[0-9]+|[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d <<= k & 1
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in order; linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        # what stands before a failed sign can't be part of a later address
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(word: str) -> int:
    """A number for the kinds of characters in a word, with the lengths of its digit runs."""
    seen = _PIECE.sub(lambda m: f"9{len(m.group())}_" if m.group()[0].isdigit() else "a", word.strip(_EDGE)[:64])
    return zlib.crc32(seen.encode()) % SHAPES


def tie(word: str) -> str:
    """What makes two words alike; '' for words too short to say so."""
    core = word.strip(_EDGE).lower()
    if "@" in core or _DOTTED.fullmatch(core):
        return core
    digits = "".join(c for c in core if c in "0123456789")
    return digits[-7:] if len(digits) >= 7 and len(core) <= 2 * len(digits) else ""


class Field:
    """The variables and ties of a batch of documents."""

    def __init__(self) -> None:
        self.shapes: list[int] = []
        self.label: list[int] = []  # observed label, or -1
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.words: list[tuple[int, int, int]] = []  # row, start, end; start -1 for plain neighbours

    def _node(self, row: int, kind: int, label: int, start: int, end: int) -> int:
        self.shapes.append(kind)
        self.label.append(label)
        self.words.append((row, start, end))
        return len(self.shapes) - 1

    def add(self, row: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        m, end, before, tied, k = _MARK.search(text), 0, -1, {}, 0
        while m:
            start = m.start()
            while start > end and not _GAP.match(text, start - 1):
                start -= 1
            stop = _GAP.search(text, m.start())
            begun, end = end, stop.start() if stop else len(text)
            while k < len(spans) and spans[k][2] <= start:
                k += 1
            observed = next((kind + 1 for a, kind, b in spans[k : k + 8] if a < end and b > start), -1)
            word = text[start:end]
            # words between this candidate and the one before: none, or plain neighbours
            if _WORD.search(text, begun, start):
                left = self._node(row, _PLAIN, 0, -1, -1)
                if before >= 0:
                    self.chain.append((before, left))
                before = left
            here = self._node(row, shape(word), observed, start, end)
            if before >= 0:
                self.chain.append((before, here))
            key = tie(word)
            if key:
                if key in tied:
                    self.skip.append((tied[key], here))
                tied[key] = here
            before, m = here, _MARK.search(text, end)
        if before >= 0 and _WORD.search(text, end):
            self.chain.append((before, self._node(row, _PLAIN, 0, -1, -1)))


def count_field(field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label counts by shape, by chain pair and by skip pair.

    Unobserved words count as none, except in a skip pair with an observed one: whether
    the patterns missed such a word is what the field is to find out.
    """
    known = np.array(field.label, np.int64) > 0
    label = np.maximum(np.array(field.label, np.int64), 0)
    own = np.bincount(np.array(field.shapes, np.int64) * LABELS + label, minlength=(SHAPES + 1) * LABELS)
    pairs = []
    for edges in (field.chain, field.skip):
        e = np.array(edges, np.int64).reshape(-1, 2)
        if edges is field.skip:
            e = e[known[e[:, 0]] == known[e[:, 1]]]
        pairs.append(np.bincount(label[e[:, 0]] * LABELS + label[e[:, 1]], minlength=LABELS**2) if len(label) else np.zeros(LABELS**2, np.int64))
    return own, *pairs


class Model:
    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        own = own.reshape(SHAPES + 1, LABELS).astype(float)
        prior = (own.sum(0) + 1) / (own.sum() + LABELS)
        seen = (own + prior) / (own.sum(1, keepdims=True) + 1)
        # what base patterns left aside may still be of its shape's kind, with small odds
        self.own = np.log(np.concatenate([1 - LOOSE * (1 - seen[:, :1]), LOOSE * seen[:, 1:]], 1))
        self.chain, self.skip = self._ratio(chain, CHAIN), self._ratio(skip + AGREE * np.eye(LABELS, dtype=np.int64).ravel(), SKIP)

    @staticmethod
    def _ratio(counts: np.ndarray, bound: float) -> np.ndarray:
        joint = counts.reshape(LABELS, LABELS).astype(float)
        joint = joint + joint.T + 0.5
        joint /= joint.sum()
        alone = joint.sum(1)
        return np.clip(np.log(joint / np.outer(alone, alone)), -np.log(bound), np.log(bound))

    def beliefs(self, field: Field) -> np.ndarray:
        """Marginals of every variable after loopy message passing."""
        n = len(field.shapes)
        own = self.own[np.array(field.shapes, np.int64)] if n else np.zeros((0, LABELS))
        label = np.array(field.label, np.int64)
        known = np.flatnonzero(label >= 0)
        own[known] = -30.0
        own[known, label[known]] = 0.0
        chain = np.array(field.chain, np.int64).reshape(-1, 2)
        root: dict[int, int] = {}
        for a, b in field.skip:
            root[b] = root.setdefault(a, a)
        tied = np.array(list(root.items()), np.int64).reshape(-1, 2)
        path = tied[np.lexsort((tied[:, 0], tied[:, 1]))]
        first = np.flatnonzero(np.r_[True, path[1:, 1] != path[:-1, 1]]) if len(path) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(path)))
        total = self._settled(own, chain, path[:, 0], np.arange(len(path)) - np.repeat(first, size), np.array([x[0] for x in field.words], np.int64))
        total = np.exp(total - total.max(1, keepdims=True)) if n else total
        return total / total.sum(1, keepdims=True)

    def _settled(self, own: np.ndarray, chain: np.ndarray, path: np.ndarray, step: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Log-beliefs once the messages of each row's variables have settled.

        ``path`` names the variables of all paths of ties, one path after another, and
        ``step`` their places in theirs.
        """
        out, where = own.copy(), np.arange(len(own))
        tied, message = np.zeros_like(own), np.zeros((2 * len(chain), LABELS))
        for turn in range(TURNS):
            source, target = np.concatenate([chain, chain[:, ::-1]]).T
            half = len(chain)
            into = np.zeros_like(own)
            np.add.at(into, target, message)
            fresh = np.zeros_like(own)
            fresh[path] = along(own[path] + into[path], step, self.skip)
            moved = np.abs(fresh - tied).max(1, initial=0)
            share = 1.0 if turn < CALM else 0.5
            tied += share * (fresh - tied)
            total = own + tied + into
            sent = (total[source] - message[np.r_[half : 2 * half, :half]])[:, :, None] + self.chain
            top = sent.max(1)
            fresh = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
            fresh -= fresh.max(1, keepdims=True)
            np.maximum.at(moved, target, np.abs(fresh - message).max(1, initial=0))
            message += share * (fresh - message)
            out[where] = total
            live = np.zeros(int(row.max(initial=-1)) + 1, bool)
            live[row[moved > TOLERANCE]] = True
            on = live[row]
            if not on.any():
                break
            if 2 * on.sum() < len(on):  # only the rows that still change go on
                number = np.cumsum(on) - 1
                go, stay = on[chain[:, 0]], on[path]
                message, chain = message[np.r_[go, go]], number[chain[go]]
                path, step = number[path[stay]], step[stay]
                own, tied, row, where = own[on], tied[on], row[on], where[on]
        return out


def along(own: np.ndarray, step: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Sums of the two messages that each variable gets along its path, 0 for the likeliest label.

    Paths lie one after another, a ``step`` of 0 begins one. Products of the matrices of
    2, 4, 8, ... ties carry messages over any length of path in few rounds.
    """
    if not len(own):
        return own
    size = np.diff(np.append(np.flatnonzero(step == 0), len(step)))
    out = np.zeros_like(own)
    for way in (1, -1):
        place = step if way == 1 else (np.repeat(size, size) - 1 - step)[::-1]
        mine = np.exp(own - own.max(1, keepdims=True))[::way]
        carry = np.concatenate([mine[:1], mine[:-1]])[:, :, None] * np.exp(pair if way == 1 else pair.T)
        reach = 1
        while reach < int(place.max()):
            far = np.flatnonzero(place > reach)
            both = np.matmul(carry[far - reach], carry[far])
            carry[far] = both / both.max((1, 2), keepdims=True)
            reach *= 2
        out += np.where(place[:, None] > 0, np.log(carry.sum(1)), 0.0)[::way]
    return out - out.max(1, keepdims=True)


def _fields(texts: list[str]) -> tuple[Field, list[list[tuple[int, int, int]]]]:
    field, spans = Field(), []
    for row, text in enumerate(texts):
        own = base_spans(text) if _MARK.search(text) else []
        spans.append(own)
        if own or _MARK.search(text):
            field.add(row, text, own)
    return field, spans


def train(docs: DataFrame) -> Model:
    """Label counts of all documents, summed by Spark; without documents all ratios are one."""
    modest_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            new = np.concatenate(count_field(_fields(strings(batch, "text"))[0]))
            sums = new if sums is None else sums + new
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at].astype(np.int64))], ["place", "n"])

    places = (SHAPES + 1) * LABELS
    sums = np.zeros(places + 2 * LABELS**2, np.int64)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "place long, n long")
    for place, n in counted.groupBy("place").agg(F.sum("n")).collect():  # bounded by SHAPES and LABELS
        sums[place] = n
    return Model(sums[:places], sums[places : places + LABELS**2], sums[places + LABELS**2 :])


def find_personal(texts: list[str], model: Model) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text as (start, kind's number, end)."""
    field, base = _fields(texts)
    every = [list(x) for x in base]
    if field.skip or any(x < 0 for x in field.label):
        belief = model.beliefs(field)
        for k in np.flatnonzero((belief[:, 1:].max(1) > 0.5) & (np.array(field.label) < 0)).tolist():
            row, start, end = field.words[k]
            every[row].append((start, int(belief[k, 1:].argmax()), end))
    return base, [sorted(x) for x in every]


def described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, checksum and spans for (doc_id, text); a null text is ''."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = find_personal(strings(batch, "text"), shared.value)
            counts = [pa.array([sum(k == n for _, k, _ in x) for x in base], pa.int64()) for n in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(described(x).encode()).hexdigest() for x in base]), pa.array([described(x) for x in every])],
                ["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        find, with_columns(docs.select("doc_id").schema, **{f"n_{x}": "long" for x in KINDS}, base_sha256="string", spans="string")
    )


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """Replace every span by its kind in angle brackets; touching spans become one. Other columns stay."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            _, every = find_personal([x or "" for x in texts], shared.value)
            out = []
            for text, spans in zip(texts, every):
                parts, end = [], 0
                for a, k, b in spans:
                    if a >= end:
                        parts += [text[end:a], f"<{KINDS[k].upper()}>"]
                    end = max(end, b)
                out.append(text if not spans else "".join([*parts, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(hide, docs.schema)


def detect_all(docs: DataFrame) -> DataFrame:
    return detect(docs, train(docs))


