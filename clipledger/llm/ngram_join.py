"""Documents whose sets of word n-grams overlap: an exact Jaccard join with token-combination prefixes.

A token is a hashed 5-word shingle; a document's set is its distinct tokens. All sets
are ordered by token. If two sets of sizes a, b share ``need = ceil(0.8 max(a, b))``
tokens, their first ``a - need(a) + m`` and ``b - need(b) + m`` tokens share m. So:

* prefixes are extended by ``spread``, about a 20th of the set, to share spread + 1 tokens;
* tokens that few prefixes hold (rare ones) are signatures themselves;
* frequent tokens are dealt to ``spread`` buckets by value; of spread + 1 shared ones two are
  in one bucket, so the signatures are the pairs of frequent tokens in a bucket.

``spread`` belongs to a class of sizes. Linked sets are of the same or the next class, so
a set signs for its own and for the class below.

Which tokens are frequent is counted over all prefixes. Tasks send tokens in packed
columns per block of token values; a block's counts are a stream's small side, so no
task holds the documents of a token.

Sets that share a signature are verified, but never all pairs of a group: first everyone
against one pivot, then the members outside the pivot's component, and at last what
remains between components, which is all that can still add a link. Equal sets are one
class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import hash_words, lower_bytes, mix, modest_batches, save, slices, word_bounds

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens of more prefixes are frequent.
RARE = 256
#: Prefix tokens of a batch and, about, of a block; documents that may be broadcast by key.
BATCH, BLOCK, SMALL_KEYS = 200_000, 1 << 20, 2_000_000
#: Pivot rounds before the rest is verified in full.
ROUNDS = 2
_U = np.uint64
_ENTRY = np.dtype([("doc", "<u4"), ("count", "<u4"), ("token", "<u8")])


# ---- sets, prefixes, signatures -----------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice; fewer words than WORDS are one shingle."""
    starts, ends, many = word_bounds(data, offsets)
    word = hash_words(lower_bytes(data), starts, ends)
    factors = [_U((0x9E3779B97F4A7C15 * (2 * k + 3)) & (1 << 64) - 1 | 1) for k in range(WORDS)]
    total = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += word[k : k + len(total)] * factors[k]
    total = mix(total)
    out, at = [], 0
    for n in many.tolist():
        if n >= WORDS:
            out.append(np.unique(total[at : at + n - WORDS + 1]))
        elif n:
            out.append(mix((word[at : at + n] * np.array(factors[:n])).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def need(size: int) -> int:
    """Tokens that a set of this size shares with every linked one, at least."""
    return -(-size * PERCENT // 100)


def size_classes(most: int) -> np.ndarray:
    """Lower bounds of classes such that linked sizes are in the same or the next one."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 100 // PERCENT + 1)
    return np.array(bounds)


_CLASSES = size_classes(1 << 40)


def spread(size: int, below: int = 0) -> int:
    """Buckets of frequent tokens for a size's class, or one ``below`` it."""
    k = max(0, int(np.searchsorted(_CLASSES, size, "right")) - 1 - below)
    return max(1, int(_CLASSES[k]) // 20)


def prefix_length(size: int) -> int:
    """Sets of one or two tokens are linked with equal ones alone and need no prefix."""
    return size - need(size) + spread(size) + 1 if size > need(size) or need(size) > spread(size) else size


def signatures(token: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Signatures of a prefix, given how many prefixes hold each token.

    A prefix with fewer than spread + 1 tokens that others hold has no link in the class.
    """
    token, count = token[count > 1], count[count > 1]
    often = count > RARE
    frequent, out = np.sort(token[often]), [np.zeros(0, np.uint64)]
    if len(token) > spread(size, 1):
        out.append(mix(token[~often]))
    for below in (0, 1):
        buckets = spread(size, below)
        if len(token) <= buckets:
            continue
        bucket = (mix(frequent) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                own = frequent[order[a:b]]
                out.append(mix(own[i] * _U(0xD6E8FEB86659FD93) + mix(own[j] + _U(1))))
    return np.unique(np.concatenate(out))


# ---- passes over the texts -------------------------------------------------------


def _packed_counts(tokens: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, values, counts) of distinct tokens; a token is its block's bits and 32 more."""
    value, count = np.unique(np.concatenate(tokens) >> _U(32 - bits), return_counts=True)
    edges = np.searchsorted(value, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(32))
    low = (value & _U(0xFFFFFFFF)).astype("<u4")
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[k], edges[k + 1])
        yield k, low[part].tobytes(), count[part].astype("<u4").tobytes()


def read_sets(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of kind 0: a document's key, size and 128-bit set hash; of kind 1: packed counts of prefix tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def counts() -> pa.RecordBatch:
            rows = list(zip(*_packed_counts(waiting, bits))) or [(), (), ()]
            n = len(rows[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                ["kind", "doc_id", "n", "lo", "hi", "block", "keys", "counts"],
            )

        for batch in batches:
            sizes, low, high = [], [], []
            known = ~np.asarray(batch.column(0).is_null())
            for first, _, data, offsets in slices(batch.column(1)):
                for k, own in enumerate(shingle_sets(data, offsets)):
                    sizes.append(len(own))
                    low.append(own.sum(dtype=np.uint64))
                    high.append(mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if len(own) > 2 and known[first + k]:
                        waiting.append(own[: prefix_length(len(own))])
                        held += len(waiting[-1])
                if held >= 1 << 20:
                    yield counts()
                    waiting, held = [], 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)), *(pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary()))],
                ["kind", "doc_id", "n", "lo", "hi", "block", "keys", "counts"],
            )
        if waiting:
            yield counts()

    return docs.mapInArrow(read, "kind int, doc_id long, n long, lo long, hi long, block long, keys binary, counts binary")


def sum_counts(packed: DataFrame) -> DataFrame:
    """Per block the tokens of at least two prefixes, sorted, with their counts."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, total = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for batch in batches:
            keys = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(batch.schema.get_field_index("keys"))]
            counts = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(batch.schema.get_field_index("counts"))]
            value, where = np.unique(np.concatenate([value, *keys]), return_inverse=True)
            total = np.bincount(where, np.concatenate([total, *counts])).astype(np.int64)
        shared = total > 1
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([value[shared].tobytes()], pa.binary()), "counts": pa.array([np.minimum(total[shared], 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())}
        )

    return packed.groupBy("block").applyInArrow(add, "block long, keys binary, counts binary")


def prefixes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, size, prefix) of the rows of (doc_id, text) that may have a link."""
    ids = batch.column(0).to_pylist()
    for first, _, data, offsets in slices(batch.column(1)):
        for k, own in enumerate(shingle_sets(data, offsets)):
            if len(own) > 2 and ids[first + k] is not None:
                yield ids[first + k], len(own), own[: prefix_length(len(own))]


def stored(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, size, tokens) of rows of (doc_id, tokens)."""
    for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
        own = np.frombuffer(raw.as_buffer(), np.uint64)
        yield key, len(own), own


def ask_counts(rows: DataFrame, bits: int, tokens_of=prefixes) -> DataFrame:
    """Packed tokens per (batch of documents, block); a block below 0 has a batch's keys and sizes.

    Batches are numbered by task, so the rows must be computed by one shuffle only.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32

        def packed(keys: list[int], sizes: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
            value = np.concatenate(tokens) >> _U(32 - bits)
            doc = np.repeat(np.arange(len(tokens), dtype="<u4"), [len(x) for x in tokens])
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order]
            edges = np.searchsorted(value, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(32))
            low = (value & _U(0xFFFFFFFF)).astype("<u4")
            rows = [(-1 - (turn & (1 << bits) - 1), np.array(keys, "<i8").tobytes(), np.array(sizes, "<i8").tobytes())]
            small = "<u2" if len(tokens) < 1 << 16 else "<u4"
            rows += [(k, low[edges[k] : edges[k + 1]].tobytes(), doc[edges[k] : edges[k + 1]].astype(small).tobytes()) for k in np.flatnonzero(np.diff(edges)).tolist()]
            block, left, right = zip(*rows)
            return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "batch": pa.array([turn] * len(rows), pa.int64()), "keys": pa.array(left, pa.binary()), "docs": pa.array(right, pa.binary())})

        keys, sizes, tokens, held = [], [], [], 0
        for batch in batches:
            for key, size, own in tokens_of(batch):
                keys.append(key)
                sizes.append(size)
                tokens.append(own)
                held += len(own)
                if held >= BATCH:
                    yield packed(keys, sizes, tokens)
                    turn, keys, sizes, tokens, held = turn + 1, [], [], [], 0
        if tokens:
            yield packed(keys, sizes, tokens)

    return rows.mapInArrow(ask, "block long, batch long, keys binary, docs binary")


def answer(asked: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """Per (batch, block) the entries (document, count, token) of tokens that several prefixes hold.

    A block's counts come first in the sorted stream and stay in memory while its
    questions pass by, however many they are.
    """
    first = counted.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "keys", F.col("counts").alias("docs"))
    rest = asked.select("block", F.lit(1).alias("kind"), "batch", "keys", "docs")
    merged = first.unionByName(rest).repartition(parts, "block").sortWithinPartitions("block", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = np.zeros(0, "<u4"), np.zeros(0, "<u4")
        for batch in batches:
            out = []
            for block, kind, asker, keys, docs in zip(*(batch.column(k) for k in range(5))):
                if block.as_py() < 0:
                    out.append((asker.as_py(), None, keys.as_py(), docs.as_py()))
                    continue
                if kind.as_py() == 0:
                    value, count = np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(docs.as_buffer(), "<u4")
                    continue
                asked = np.frombuffer(keys.as_buffer(), "<u4")
                raw = docs.as_buffer()
                doc = np.frombuffer(raw, "<u2" if raw.size == 2 * len(asked) else "<u4")
                at = np.minimum(np.searchsorted(value, asked), max(0, len(value) - 1))
                good = value[at] == asked if len(value) else np.zeros(len(asked), bool)
                entry = np.zeros(int(good.sum()), _ENTRY)
                entry["doc"], entry["count"] = doc[good], count[at[good]]
                entry["token"] = (_U(block.as_py()) << _U(32)) | asked[good].astype(np.uint64)
                if len(entry):
                    out.append((asker.as_py(), entry.tobytes(), None, None))
            asker, *rest = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"batch": pa.array(asker, pa.int64())} | {x: pa.array(y, pa.binary()) for x, y in zip(("entries", "keys", "docs"), rest)})

    return merged.mapInArrow(look, "batch long, entries binary, keys binary, docs binary")


def sign(answers: DataFrame) -> DataFrame:
    """(sig, doc_id, n) of every document that has a signature."""

    def collect(key: tuple, group: pa.Table) -> pa.Table:
        entries = [np.frombuffer(x.as_buffer(), _ENTRY) for x in group.column("entries") if x.is_valid]
        head = next((i for i, x in enumerate(group.column("keys")) if x.is_valid), None)
        sigs, keys, sizes = [np.zeros(0, np.uint64)], [], []
        if entries and head is not None:
            ids = np.frombuffer(group.column("keys")[head].as_buffer(), "<i8")
            size = np.frombuffer(group.column("docs")[head].as_buffer(), "<i8")
            found = np.concatenate(entries)
            found = found[np.argsort(found["doc"], kind="stable")]
            edges = np.searchsorted(found["doc"], np.arange(len(ids) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = found[edges[k] : edges[k + 1]]
                sigs.append(signatures(own["token"].copy(), own["count"], int(size[k])))
                keys.append(np.full(len(sigs[-1]), ids[k]))
                sizes.append(np.full(len(sigs[-1]), size[k]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"sig": np.concatenate(sigs).view(np.int64), "doc_id": np.concatenate(none + keys), "n": np.concatenate(none + sizes)})

    return answers.groupBy("batch").applyInArrow(collect, "sig long, doc_id long, n long")


def token_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the whole sorted set as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [own.tobytes() for _, _, data, offsets in slices(batch.column(1)) for own in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    return docs.mapInArrow(pack, "doc_id long, tokens binary")


def count_tokens(sets: DataFrame, bits: int) -> DataFrame:
    """Packed counts of the tokens of stored sets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def counts() -> pa.RecordBatch:
            block, keys, n = zip(*_packed_counts(waiting, bits))
            return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(n, pa.binary())})

        for batch in batches:
            for _, size, own in stored(batch):
                waiting.append(own)
                held += size
                if held >= 1 << 20:
                    yield counts()
                    waiting, held = [], 0
        if waiting:
            yield counts()

    return sets.mapInArrow(read, "block long, keys binary, counts binary")


def shared_tokens(sets: DataFrame, bits: int, parts: int) -> DataFrame:
    """(doc_id, n, shared): how many tokens of a stored set another stored set holds, too."""
    counted = sum_counts(count_tokens(sets, bits))
    answers = answer(ask_counts(sets, bits, stored), counted, parts)

    def total(key: tuple, group: pa.Table) -> pa.Table:
        head = next((i for i, x in enumerate(group.column("keys")) if x.is_valid), None)
        if head is None:
            return pa.table({x: pa.array([], pa.int64()) for x in ("doc_id", "n", "shared")})
        ids, size = (np.frombuffer(group.column(x)[head].as_buffer(), "<i8") for x in ("keys", "docs"))
        found = [np.frombuffer(x.as_buffer(), _ENTRY)["doc"] for x in group.column("entries") if x.is_valid]
        shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), minlength=len(ids))
        return pa.table({"doc_id": ids, "n": size, "shared": shared})

    return answers.groupBy("batch").applyInArrow(total, "doc_id long, n long, shared long")


# ---- links and components ----------------------------------------------------------


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, linked) of pairs (a, b): their common tokens; a pivot's set is joined last, to all its pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both.append(int((many[at] == few).sum()))
                linked.append(100 * both[-1] >= PERCENT * (len(x) + len(y) - both[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right")), "b")
    with_a = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left")), "a")
    told = with_a.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long, both long, linked boolean")
    # a key with several rows has several sets: what links one of them links the key
    return told.groupBy("a", "b").agg(F.max("both").alias("both"), F.max("linked").alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links: the smallest node it reaches.

    Labels take the least of their neighbours' and then of their label's label, so
    paths halve in every round.
    """
    edges = save(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = save(edges.groupBy("x").agg(F.min("y").alias("_m")).select(F.col("x").alias("node"), F.least("x", "_m").alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        stepped = labels.join(near.select(F.col("x").alias("node"), "near"), "node").select("node", "comp", F.least("comp", "near").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("comp").alias("above"))
        moved = save(stepped.join(above, "new").select("node", F.least("new", "above").alias("new"), "comp"))
        labels = moved.select("node", F.col("new").alias("comp"))
        if moved.where("new <> comp").isEmpty():
            return labels


def reaches(common, a: str, b: str):
    """Whether so many common tokens make a link of sets of these sizes."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT) & (common * (100 + PERCENT) >= (F.col(a) + F.col(b)) * PERCENT)


def _order(turn: int):
    """First the members near the middle of their group, then an order of each round's own."""
    own = F.xxhash64("doc_id", F.lit(turn)).alias("by")
    return F.struct((F.col("n") - F.col("shared") if not turn else F.lit(0)).alias("alone"), own, "doc_id", "n", "shared")


def link_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, comp) of linked documents, given (sig, doc_id, n, shared) of groups of two and more.

    The first pivot of a group has the fewest tokens of its own: edited copies have
    some, the text they were made from has none. Common tokens with a pivot also bound
    the common tokens of two members: at most the fewer of both, plus the fewer of
    what each shares outside the pivot. So only few pairs are left for the end.
    """
    labels = save(groups.select("doc_id").distinct().withColumn("comp", F.col("doc_id")))
    seen: list[DataFrame] = []

    def take(pairs: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
        new = pairs.where("a <> b").distinct()
        for old in seen:
            new = new.join(old.select("a", "b").unionByName(old.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        seen.append(save(verify(save(new), sets)))
        links = seen[-1].where("linked").select("a", "b")
        ends = links.join(labels.select(F.col("doc_id").alias("a"), F.col("comp").alias("_a")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("comp").alias("_b")), "b")
        ends = save(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if ends.isEmpty():
            return labels, False
        joined = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
        return save(labels.join(joined, "comp", "left").select("doc_id", F.coalesce("_new", "comp").alias("comp"))), True

    anchors = None
    for turn in range(ROUNDS):
        placed = groups.join(labels, "doc_id")
        if turn:
            # groups that are of one component have no link left to give
            mixed = placed.groupBy("sig").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l < _h").select("sig")
            groups = save(groups.join(mixed, "sig", "left_semi"))
            placed = groups.join(labels, "doc_id")
        # one pivot per group, of its largest component
        held = placed.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("m"), F.min(_order(turn)).alias("_p"))
        best = F.struct("m", F.col("_p.alone").alias("alone"), "comp", "_p") if turn else F.struct("m", -F.col("_p.alone"), -F.col("_p.by"), "comp", "_p")
        pivots = held.groupBy("sig").agg(F.max(best).alias("_x")).select("sig", F.col("_x._p.doc_id").alias("a"), F.col("_x._p.n").alias("_n"), F.col("_x._p.shared").alias("_s"), F.col("_x.comp").alias("_c"))
        stars = placed.join(pivots, "sig").where(F.col("comp") != F.col("_c"))
        if turn:  # the first comparison also serves the bound, so it's for everyone
            stars = stars.where(reaches(F.least("shared", "_s"), "n", "_n"))
        labels, more = take(stars.select("a", F.col("doc_id").alias("b")), labels)
        if not turn:
            # each member's anchor: of the pivots it was compared with, the one of most members
            told = seen[0].select("a", "b", "both").unionByName(seen[0].join(sets.select(F.col("doc_id").alias("a"), (F.octet_length("tokens") / 8).cast("long").alias("_n")), "a").select("a", F.col("a").alias("b"), F.col("_n").alias("both")).distinct())
            often = seen[0].groupBy("a").agg(F.count(F.lit(1)).alias("m"))
            anchors = told.join(often, "a").groupBy("b").agg(F.max(F.struct("m", "a", "both")).alias("_x"))
            anchors = save(anchors.select(F.col("b").alias("doc_id"), F.col("_x.a").alias("anchor"), F.col("_x.both").alias("within")))
        if not more:
            break
    # what is left between components: members outside their group's largest one against all others;
    # members of one anchor meet there once, whatever number of signatures they share
    placed = save(groups.join(labels, "doc_id").join(anchors, "doc_id", "left"))
    facts = ["doc_id", "n", "shared", "comp", "anchor", "within"]

    def outsiders(rows: DataFrame, key: str) -> DataFrame:
        per = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("m")).groupBy(key)
        largest = per.agg(F.max(F.struct("m", "comp")).alias("_x")).select(key, F.col("_x.comp").alias("_c"))
        return rows.join(largest, key).where("comp <> _c").select(key, *(F.col(x).alias(f"_{x}") for x in facts if x != key))

    apart = F.col("comp") != F.col("_comp")
    beyond = F.least(F.col("shared") - F.col("within"), F.col("_shared") - F.col("_within"))
    members = placed.select(*facts).distinct()
    same = members.join(outsiders(members, "anchor"), "anchor").where(apart).where(reaches(F.least("within", "_within") + beyond, "n", "_n"))
    other = placed.join(outsiders(placed, "sig"), "sig").where(apart & ~F.col("anchor").eqNullSafe(F.col("_anchor")))
    other = other.where(reaches(F.least("shared", "_shared"), "n", "_n"))
    pair = [F.least("_doc_id", "doc_id").alias("a"), F.greatest("_doc_id", "doc_id").alias("b")]
    return take(same.select(*pair).unionByName(other.select(*pair)), labels)[0]


def join_documents(docs: DataFrame) -> DataFrame:
    """``n_shingles`` and ``component_id`` of each row of (doc_id, text).

    Texts without a word have no shingle and are linked with nothing. A null key gets
    no component and links nobody. Rows that repeat a key have the key's component.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.count()
    bits = max(0, (rows * 100 // BLOCK).bit_length())
    read = save(read_sets(docs, bits))
    sized = read.where("kind = 0").select("doc_id", "n", "lo", "hi")
    # equal sets are one class, called by its smallest key
    classes = save(sized.where("n > 0 and doc_id is not null").groupBy("n", "lo", "hi").agg(F.min("doc_id").alias("cls")))
    counted = save(sum_counts(read.where("kind = 1").select("block", "keys", "counts")))
    answers = save(answer(ask_counts(docs, bits), counted, max(1, 1 << bits)))
    signed = sign(answers).join(classes.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi")
    signed = save(signed)
    # signatures of the same members tell the same: one of them stays
    members = [F.count(F.lit(1)).alias("_m"), F.min("doc_id").alias("_l"), F.max("doc_id").alias("_h")]
    # sums, because repeated rows cancel out of an exclusive or
    members += [F.sum(F.shiftright(F.xxhash64("doc_id", F.lit(k)), 24)).alias(f"_x{k}") for k in (1, 2)]
    several = signed.groupBy("sig").agg(*members).where("_l < _h").groupBy("_m", "_l", "_h", "_x1", "_x2").agg(F.min("sig").alias("sig"))
    groups = save(signed.join(several.select("sig"), "sig", "left_semi"))
    keys = save(groups.select("doc_id").distinct())
    wanted = F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys
    sets = save(token_sets(docs.join(wanted, "doc_id", "left_semi")))
    # tokens that no other candidate holds can't be in an intersection: many sets need no comparison at all
    shared = save(shared_tokens(sets, bits, max(1, 1 << bits)))
    hopeful = shared.where(F.col("shared") * 100 >= F.col("n") * PERCENT).groupBy("doc_id").agg(F.max("shared").alias("shared"))
    groups = save(groups.join(hopeful, "doc_id"))
    labels = link_groups(groups, sets).select(F.col("doc_id").alias("cls"), "comp")
    named = save(classes.join(labels, "cls", "left").select("n", "lo", "hi", F.coalesce("comp", "cls").alias("comp")))
    joined = sized.join(named, ["n", "lo", "hi"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does; null keys stay.

    Where keys repeat, rows are judged by their own text: one of equal rows stays, and
    so does a text without a copy whose key also has one with copies.
    """
    keys = docs.where("doc_id is not null").groupBy("doc_id").count()
    if keys.where("count > 1").isEmpty():
        gone = join_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
        key, rows = "doc_id", docs
    else:
        key = next(x for x in (f"_row{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
        rows = save(docs.withColumn(key, F.monotonically_increasing_id()))  # stored, so that it never changes
        told = join_documents(rows.where("doc_id is not null").select(F.col(key).alias("doc_id"), "text"))
        told = save(told.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key))
        first = told.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("_f")).select("component_id", F.col(f"_f.{key}").alias("_first"))
        gone = told.join(first, "component_id").where(F.col(key) != F.col("_first")).select(key)
    gone = save(gone)
    kept = rows.join(F.broadcast(gone) if gone.count() <= SMALL_KEYS else gone, key, "left_anti")
    return kept.select(*docs.columns)
