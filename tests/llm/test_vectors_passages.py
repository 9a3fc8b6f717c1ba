"""Whitening, hard negatives and repeated passages."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.llm import hard_negatives, substrings, vectors, whitening

ROWS = "vec_id long, embedding array<float>, label int"


def vector_rows(rng, n, d=6, labels=3):
    return [(k, [float(x) for x in rng.normal(size=d) / 3], int(rng.integers(labels))) for k in range(n)]


# ---- whitening ----


def plain_whitening(rows, d):
    keep = [(k, v) for k, v, _ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([np.floor(np.array(v, np.float32).astype(float) * 64) + 1_000_000 for _, v in keep])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    value, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    deviation = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(0))) for row in x]
    white = (x - fit.mean(0)) @ axes[:, ::-1] / np.sqrt(np.maximum(value[::-1], 1e-300))
    return [k for k, _ in keep], len(fit), deviation, white, value[::-1] / value.sum()


def test_whitening_matches_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    rows = vector_rows(rng, 300)
    rows += [(k, rows[0][1], 1) for k in range(300, 420)]  # a large group of one vector counts once
    rows += [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [1.0], 1), (None, rows[3][1], 1)]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, ROWS).withColumn("component", F.lit("old"))).collect()
    ids, n, deviation, white, share = plain_whitening(rows, 6)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(ids) * 6 and set(by) == set(ids)
    for k, own, dev in zip(ids, white, deviation):
        for c in range(1, 7):
            r = by[k][c]
            assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share[c - 1], rel=1e-10)
            assert abs(r.whitened) == pytest.approx(abs(own[c - 1]), abs=1e-8) and r.identity_error < 1e-10
    for c in range(6):  # one sign per component
        signs = {round(by[k][c + 1].whitened / w[c], 6) for k, w in zip(ids, white) if abs(w[c]) > 0.01}
        assert len(signs) == 1


def test_no_variance_no_component(spark):
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert whitening.whiten_embeddings(frame([])).count() == 0
    assert whitening.whiten_embeddings(frame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])).count() == 0
    flat = whitening.whiten_embeddings(frame([(k, [k / 8, 0.25, k / 4], 0) for k in range(9)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0)


@pytest.mark.parametrize("value", [[5, 5 - 1e-12, 5 - 2e-12, 3, 3 - 1e-9, 1, 1, 0.5], [2] * 8, [1e12, 1, 1 - 1e-13, 1e-3, 1e-9, 1e-9, 0, 0]])
def test_clustered_eigenvalues(value):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(8, dtype=np.longdouble) - 0.5 * q.T @ q)
    a = (q * np.array(value, np.longdouble)) @ q.T
    found, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(found - np.array(value, np.longdouble)).max() <= 1e-17 * max(value) * 8
    assert np.abs(a @ x - x * found).max() <= 1e-17 * max(value) * 8 and np.abs(x.T @ x - np.eye(8)).max() < 1e-17


def test_products_are_exact_for_large_numbers():
    rng = np.random.default_rng(4)
    y = rng.integers(-(1 << 50), 1 << 50, size=(50, 3))
    total = np.zeros((3, 3), object)
    whitening.add_products(total, y)
    assert (total == y.astype(object).T @ y.astype(object)).all()
    small = np.array([[0, 0], [1, -1], [256, 0], [-(1 << 20), 5]])
    assert (vectors.unpacked(vectors.pa.array(vectors.packed(small), vectors.pa.binary()), 2) == small).all()


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(1, 64, 3, np.array([0], object), np.zeros((1, 1)), np.ones(1), np.ones(1))
    assert model.deviation(np.array([[1 << 40], [2], [-1]])) == [None, 36, 9]


# ---- hard negatives ----


def plain_negatives(rows, every):
    known = {}
    for k, v, y in rows:
        if k is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[k] = ([math.floor(256 * float(np.float32(x))) for x in v], y)
    out = []
    for a in sorted(known):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(known[a][0], v)), k, y) for k, (v, y) in known.items())
        for score, k, _ in [x for x in scored if x[2] == known[a][1] and x[1] != a][:5]:
            fits = [x for x in scored if x[2] != known[a][1] and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(a, k, n + 1, x[1], -score, -x[0]) for n, x in enumerate(fits)]
    return out


@pytest.mark.parametrize("sizes", [(65_536, 65_536, 16, 2_048, 1_024), (40, 3, 2, 16, 2)])
def test_hard_negatives_match_all_pairs(monkeypatch, spark, sizes):
    for name, size in zip(("GROUP", "CHUNK", "GROUPS", "BLOCK", "TILE"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = np.random.default_rng(6)
    rows = vector_rows(rng, 200)
    rows += [(k, rows[k % 3][1], int(k % 4)) for k in range(200, 300)]  # many ties, and all labels share three vectors
    rows += [(-10, [0.1] * 6, 0), (301, [0.0] * 6, 2), (310, [0.0] * 6, 2)]
    odd = [(400, None, 1), (401, [float("nan")] * 6, 1), (402, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    frame = spark.createDataFrame([*rows, *odd, rows[5]], ROWS).withColumn("rank", F.lit(0))
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain_negatives(rows, 10))


def test_anchors_and_labels_of_the_table(spark):
    rng = np.random.default_rng(7)
    rows = vector_rows(rng, 160, labels=10)
    got = hard_negatives.mine_embeddings(spark.createDataFrame(rows, ROWS)).collect()
    moved = [(k, v, (y + 1) % 10 if k % 7 == 0 else y) for k, v, y in rows]
    assert sorted(map(tuple, got)) == sorted(plain_negatives(moved, 50))
    assert hard_negatives.mine_embeddings(spark.createDataFrame([], ROWS)).count() == 0


def test_keys_sort_by_anchor_score_kind_and_id():
    rows = [(a, s, k, i) for a in (-5, 0, 7) for s in (9, 0, -(1 << 40)) for k in (0, 1) for i in (-1, 3)]
    random.Random(1).shuffle(rows)
    packed = [hard_negatives.pack_keys(np.array([a]), np.array([s]), k, np.array([i]))[0].as_py() for a, s, k, i in rows]
    told = [hard_negatives.unpack_keys(hard_negatives.pa.array([x])) for x in sorted(packed)]
    assert [tuple(x[0] for x in y) for y in told] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_scores_beyond_a_long_are_an_error():
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[1 << 50]]), np.array([[1 << 50]]))
    assert hard_negatives.products(np.array([[1 << 30, 3]]), np.array([[1 << 30, 1]])).tolist() == [[(1 << 60) + 3]]


# ---- repeated passages ----


def plain_removal(rows):
    """(key, words, removed, kept) per row: windows of one key are one document's."""
    first, split = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        split.append((key, words))
        for k in range(len(words) - 19):
            place = ((key is not None, key or 0), k)
            old = first.setdefault(tuple(words[k : k + 20]), place)
            first[tuple(words[k : k + 20])] = min(old, place)
    out = []
    for key, words in split:
        gone = set()
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] < ((key is not None, key or 0), k):
                gone.update(range(k, k + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((key, len(words), len(gone), kept))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    fill = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    shared, line = fill(60), fill(7)
    rows = [(k, f"{fill(rng.randint(0, 40))} {shared}\t{fill(rng.randint(0, 30))}\n") for k in range(20)]
    rows += [(100 + k, rows[k % 4][1].replace("w1 ", "W1 ", 1)) for k in range(40)]  # near copies
    rows += [(200, f"{line} " * 40), (201, f"é日本 {line} " * 30), (202, shared), (203, shared.upper()), (204, "one word " * 3)]
    rows += [(205, " ".join(shared.split()[:19])), (206, "x" * 5000 + " " + shared)]
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 19, 1 << 21), (500, 60, 100)])
def test_repeats_match_all_windows(monkeypatch, documents, sizes):
    for name, size in zip(("SHARD", "BATCH", "BLOCK"), sizes):
        monkeypatch.setattr(substrings, name, size)
    rows = passages(sizes[0])
    got = substrings.drop_repeats(documents(rows, ranges="old", sign=4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == plain_removal(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_odd_rows(documents):
    text = " ".join(f"v{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (None, "short"), (5, text), (5, text), (5, f"first {text}"), (7, text + " " + text), (8, "z " * 9_000)]
    got = substrings.drop_repeats(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == plain_removal(rows)
    assert substrings.drop_repeats(documents([])).count() == 0
    alone = {(r.doc_id, r.n_removed) for r in substrings.drop_repeats(documents([(4, text), (4, text), (6, text)])).collect()}
    assert alone == {(4, 0), (6, 50)}


def test_marks_that_are_too_many_change_nothing(monkeypatch, documents):
    monkeypatch.setattr(substrings, "MARKS", 13)
    monkeypatch.setattr(substrings, "PARTS", 4)
    rows = passages(9)
    got = substrings.drop_repeats(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == plain_removal(rows)
