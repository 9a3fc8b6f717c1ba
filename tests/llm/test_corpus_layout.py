"""Packing, the n-gram join, sharding, the token store, the language model and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipledger.llm import base, causal_lm, ngram_join, packing, sharding, token_store, tokens
from clipledger.llm.tokens import Encoder, encoder, tokenizer_path

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (None, "no key"), (5, "twice"), (5, "twice"), (6, "é ñ 日本 😀 " * 3), (7, "long " * 9_000)]
TOKENIZER = "word_bpe_49k.json"


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


# ---- tokens ----


def test_cached_ids_are_the_librarys():
    texts = ["", "Hello, World. it's 'RE x.' <|endoftext|> <|EndOfText|>", "a" * 200 + " b", "é ñ. ,. .", "x y z", "İstanbul. Ḱ ́a", None, "don't. 'll, x'd, 12.5, 3,", "😀. 日本語. a.."]
    mine = Encoder(tokenizer_path(TOKENIZER))
    want = [mine.library.encode(x or "", add_special_tokens=False).ids for x in texts]
    for some in (texts, texts[::-1]):
        got = [ids[at[k] : at[k + 1]].tolist() for _, _, ids, at in mine.column(pa.array(some, pa.string())) for k in range(len(at) - 1)]
        assert got == (want if some is texts else want[::-1])


def test_words_are_those_between_ascii_spaces():
    texts = ["  a b\tc\n", "", "x", None, "d\x0be\x0cf", " "]
    for _, _, data, offsets in base.slices(pa.array(texts, pa.string())):
        starts, ends, many = base.word_bounds(data, offsets)
        assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == list("abcxdef")
        assert many.tolist() == [3, 0, 1, 0, 3, 0]


# ---- packing ----


def check_plan(counts, capacity, **how):
    runs, sequences = packing.plan_runs(counts, capacity, **how)
    seen, held = Counter(), defaultdict(list)
    for length, rank, many, first, per, offset in runs.tolist():
        for k in range(many):
            seen[length, rank + k] += 1
            held[first + k // per].append((offset + k % per * length, length))
    assert seen == Counter({(n, k): 1 for n in range(1, capacity + 1) for k in range(int(counts[n]))})
    assert len(held) == sequences
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(3)
    for n, capacity in ((0, 16), (1, 16), (400, 16), (900, 64), (3000, 256)):
        counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
        check_plan(counts, capacity, groups=6)


def test_plans_are_close_to_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(512, rng.lognormal(4, 1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=513)
    assert check_plan(counts, 512) <= 1.02 * lengths.sum() / 512 + 1
    halves = np.zeros(101, np.int64)
    halves[[50, 30, 20]] = 100, 100, 100
    assert check_plan(halves, 100) <= 101


def test_packed_documents_hold_their_ids(documents):
    rng = random.Random(6)
    rows = [*ODD, *((k, prose(rng, rng.randint(0, 300))) for k in range(10, 60))]
    got = packing.pack_documents(documents(rows, piece="old", sequence_id=3)).collect()
    library = encoder(tokenizer_path(TOKENIZER)).library
    want = Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        ends = [0, *(a + n for a, n in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 4096
    assert packing.pack_documents(documents([])).count() == 0


# ---- n-gram join ----


def shingles(text):
    low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def plain_components(rows):
    sets = {k: shingles(t) for k, t in rows if k is not None}
    above = {k: k for k in sets}

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {k: (len(s), top(k)) for k, s in sets.items()}


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 60)}"
    return " ".join(words)


@pytest.mark.parametrize("rare,bits", [(16, 0), (2, 3)])
def test_components_match_all_pairs(documents, monkeypatch, rare, bits):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK", 1 << 20 if not bits else 1500)
    rng = random.Random(12)
    rows, key = [], 0
    for _ in range(8):
        text = prose(rng, rng.choice([6, 20, 60, 150]), 5000)
        for _ in range(12):
            rows.append((key, edited(rng, text, rng.randint(0, 4))))
            key += 3
    shared = prose(rng, 55, 5000)
    rows += [(key + k, f"{prose(rng, rng.randint(3, 60), 5000)} {shared}") for k in range(25)]
    rows += [(1001 + k, "the same text of nine words in each row") for k in range(30)]
    rng.shuffle(rows)
    got = ngram_join.join_documents(documents(rows, component_id=9)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(3, 200))
        pool = np.unique(rng.integers(1, 1 << 60, 2 * size + 20, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:size])
        keep = int(rng.integers(ngram_join.need(size), size + 1))
        other = np.setdiff1d(pool, a)
        b = np.sort(np.concatenate([rng.permutation(a)[:keep], rng.permutation(other)[: int(rng.integers(0, size // 5 + 1))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * len(np.union1d(a, b)):
            continue
        count = {int(t): int(rng.choice([2, 100])) for t in pool}
        signed = [set(ngram_join.signatures(x[: ngram_join.prefix_length(len(x))], np.array([count[int(t)] for t in x[: ngram_join.prefix_length(len(x))]]), len(x)).tolist()) for x in (a, b)]
        assert np.array_equal(a, b) or signed[0] & signed[1]


def test_join_of_odd_rows(documents):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_documents(documents(ODD)).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (None, 1, None): 1, (5, 1, 5): 2, (6, 4, 6): 1, (7, 1, 7): 1})
    assert ngram_join.join_documents(documents([])).count() == 0


# ---- sharding ----


def test_shards_are_even_and_keep_groups(spark, documents):
    rng = random.Random(7)
    rows = [(k, f"group {rng.randint(0, 40)}") for k in range(120)] + [(k, f"alone {k}") for k in range(120, 501)] + [(None, None), (5, "tie"), (5, "tie")]
    sharded = sharding.shard_documents(documents(rows, shard=7, size="old"), shards=6).cache()
    got = sharded.collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    linked = sharded.where("doc_id < 120").join(documents(rows).select("doc_id", "text"), "doc_id")
    assert sharding.cut_links(linked, "text").first().cut <= 10  # 100 of 120 when dealt at random


def test_a_group_beyond_a_share_stays_split(documents):
    rows = [(k, "the same") for k in range(70)] + [(k, f"alone {k}") for k in range(70, 100)]
    got = sharding.shard_documents(documents(rows), shards=4).collect()
    assert Counter(r.shard for r in got) == Counter({0: 25, 1: 25, 2: 25, 3: 25})
    assert sharding.shard_documents(documents([]), shards=4).count() == 0


def test_sharding_runs_no_python(documents):
    plan = sharding.shard_documents(documents([(1, "a"), (2, "a"), (3, "b")]), shards=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- token store ----


def test_index_parts_are_minimal_and_reject_strangers():
    rng = np.random.default_rng(2)
    keys = rng.permutation(20_000)[:5_000].astype(np.int64)
    hashes = token_store.key_hashes(keys)
    index = token_store.Index(token_store.build_index(hashes, keys % 7, keys * 2, keys % 11))
    assert sorted(index.slots(hashes).tolist()) == list(range(len(keys)))
    records, found = index.find(hashes)
    assert found.all() and (records["start"] == keys * 2).all() and (records["shard"] == keys % 7).all() and (records["ids"] == keys % 11).all()
    assert not index.find(token_store.key_hashes(np.setdiff1d(np.arange(20_000), keys)))[1].any()
    empty = token_store.Index(token_store.build_index(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))))
    assert not empty.find(hashes[:5])[1].any()


def test_stored_ids_come_back(documents, monkeypatch):
    monkeypatch.setattr(token_store, "PART_KEYS", 20)
    rng = random.Random(8)
    rows = [*ODD, *((k * 7, prose(rng, rng.randint(0, 50))) for k in range(2, 60))]
    rng.shuffle(rows)
    folder = base.working_folder(documents([]).sparkSession)
    keys, shards, parts = token_store.write_store(documents(rows, start=4), folder, shard_rows=13)
    assert shards.count() > 2 and parts.count() > 2
    got = Counter(tuple(r) for r in token_store.read_store(token_store.look_up(keys, parts), shards).collect())
    library, want, start = encoder(tokenizer_path(TOKENIZER)).library, Counter(), 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert got == want
    spark = keys.sparkSession
    stranger = token_store.look_up(spark.createDataFrame([(123456, 0), (14, 0)], "doc_id long, copy long"), parts).collect()
    assert {r.doc_id: r.n_ids is None for r in stranger} == {123456: True, 14: False}
    assert token_store.store_and_read(documents([])).count() == 0


# ---- language model ----


def test_scores_match_a_plain_model(documents, monkeypatch):
    monkeypatch.setattr(causal_lm, "COMMON", 5)
    rng = random.Random(9)
    rows = [*ODD, *((k, prose(rng, rng.randint(0, 80), 60).upper()) for k in range(10, 70))]
    got = causal_lm.score_documents(documents(rows, score="old")).collect()
    words = {(k, t): re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) + [None] for k, t in rows}
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not out(k) for w in words[k, t])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for k, t in rows:
        own = words[k, t]
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        want[k, out(k), len(own), sum(counts[w] > 0 for w in own), total, round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert causal_lm.score_documents(documents([])).count() == 0


def trained_model():
    rng = np.random.default_rng(3)
    counts = np.append(rng.integers(0, 200, 80), [0, 12])
    model = causal_lm.Model(counts)
    texts = [np.append(np.cumsum(rng.integers(1, 3, n)) % 80, 81) for n in (0, 3, causal_lm.WINDOW - 1, causal_lm.WINDOW, 200)]
    model.fit(np.concatenate([causal_lm.windows_of(model, t) for t in texts]), steps=60)
    return model, texts


def test_each_id_is_scored_once_in_its_window():
    model, texts = trained_model()
    begin = np.cumsum([0, *map(len, texts)])
    got = model.score(np.concatenate(texts), begin)
    stride = causal_lm.WINDOW - causal_lm.CONTEXT
    for text, score in zip(texts, got):
        klass = model.klass[text].astype(int)
        before, total = np.append(model.start, klass[:-1]), 0.0
        for t in range(len(text)):
            lead = 0 if t < causal_lm.WINDOW else ((t - causal_lm.WINDOW) // stride + 1) * stride
            assert not lead or t - lead >= causal_lm.CONTEXT
            seen = before[lead : t + 1]
            weight = model.weight[before[t], seen] * model.near[t - np.arange(lead, t + 1)]
            logit = weight / weight.sum() @ model.value[seen] + model.rest[before[t]]
            total += (logit[klass[t]] - np.log(np.exp(logit).sum())) / np.log(10) + model.share[text[t]]
        assert abs(total - score) < 1e-3


def test_the_model_is_a_distribution_and_learns():
    model, texts = trained_model()
    for k in range(causal_lm.CLASSES):
        own = np.flatnonzero(model.klass == k)
        assert not len(own) or abs((10.0 ** model.share[own]).sum() - 1) < 1e-4
    fresh = causal_lm.Model(np.append(np.random.default_rng(3).integers(0, 200, 80), [0, 12]))
    ids, begin = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    assert model.score(ids, begin).sum() > fresh.score(ids, begin).sum() + 10


def test_an_id_depends_on_the_id_before_it(spark, monkeypatch):
    for name, value in (("CONTEXTS", 16), ("COLUMNS", 4), ("BLOCK", 64), ("PAIRS", 500)):
        monkeypatch.setattr(causal_lm, name, value)
    rng = np.random.default_rng(8)
    texts = [(rng.integers(0, 70, rng.integers(0, 40)) * np.array([1, 0])[k % 2] + np.cumsum(rng.integers(1, 3, 1))).astype(np.uint16) for k in range(300)]
    df = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(texts)], "doc_id long, check long, ids binary")
    model = causal_lm.Model(np.append(np.bincount(np.concatenate(texts), minlength=75), [0, len(texts)]))
    got = causal_lm.count_pairs(model, df.repartition(3))
    want, end, alone = np.zeros(len(got)), len(model.klass) - 1, causal_lm.CLASSES - causal_lm.TIERS
    for text in texts:
        own = [*text.tolist(), end]
        for before, x in zip([end, *own], own):
            if model.klass[x] >= alone:
                want[((int(model.klass[x]) - alone) * 16 + int(model.row[before])) * 4 + int(model.column[x])] += 1
    assert got.tolist() == want.tolist() and want.sum() > 1000
    model.learn_pairs(got)
    # still a distribution over the ids of a class, whatever stands before
    for before in range(len(model.klass)):
        for k in range(alone, causal_lm.CLASSES):
            own = np.flatnonzero(model.klass == k)
            chance = 10.0 ** (model.share[own].astype(float) + model.after[model.cells(own, np.full(len(own), before))])
            assert not len(own) or abs(chance.sum() - 1) < 1e-4
    assert np.abs(model.after).max() > 0.1


def test_words_of_one_class_are_told_apart_by_what_stands_before(spark):
    rng = np.random.default_rng(5)
    # every id of the second half follows its own id of the first half
    texts = [np.stack([x, x + 500], 1).ravel().astype(np.uint16) for x in (rng.integers(0, 500, 40) for _ in range(400))]
    df = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(texts)], "doc_id long, check long, ids binary")
    model = causal_lm.train(df)
    pairs = np.stack([np.arange(500), np.arange(500, 1000)], 1)
    pairs = pairs[(model.klass[pairs] >= causal_lm.CLASSES - causal_lm.TIERS).all(1)]
    end = len(model.klass) - 1
    at, other = np.arange(len(pairs)), np.roll(np.arange(len(pairs)), 1)
    same = model.klass[pairs[at, 1]] == model.klass[pairs[other, 1]]
    ids = lambda order: np.concatenate([pairs[at, 0][:, None], pairs[order, 1][:, None], np.full((len(pairs), 1), end)], 1).ravel()
    begin = np.arange(len(pairs) + 1) * 3
    right, wrong = (model.score(ids(order), begin) for order in (at, other))
    # scores without the id before are equal but for the ids' own shares
    assert same.sum() > 20 and (right - wrong)[same].mean() > 0.5


def test_every_id_of_a_short_text_is_learnt_once():
    model = causal_lm.Model(np.append(np.random.default_rng(3).integers(1, 200, 80), [0, 12]))
    ids = np.append(np.arange(1, 30), 81)
    for n in (1, 5, causal_lm.WINDOW, causal_lm.WINDOW + 6):
        windows = causal_lm.windows_of(model, ids[-n:])
        nxt = windows[:, 1:].ravel()
        assert nxt[nxt != causal_lm.PADDING].tolist() == model.klass[ids[-n:]].tolist()
        assert windows[0, 0] == model.start and (windows[1:, 0] == windows[:-1, -1]).all()
    before = model.score(ids[-5:], np.array([0, 5]))[0]
    model.fit(causal_lm.windows_of(model, ids[-5:]), steps=60)
    assert model.score(ids[-5:], np.array([0, 5]))[0] > before + 1


def test_padding_has_no_gradient(monkeypatch):
    one, two = (causal_lm.Model(np.append(np.random.default_rng(3).integers(1, 200, 60), [0, 12])) for _ in range(2))
    window = causal_lm.windows_of(one, np.arange(9))
    one.fit(window, steps=5)
    real = causal_lm.Model.logits
    # other classes in place of the padding change nothing
    monkeypatch.setattr(causal_lm.Model, "logits", lambda self, seen: real(self, np.where(np.arange(causal_lm.WINDOW) > 9, 7, seen)))
    two.fit(window, steps=5)
    for k in one.p:
        np.testing.assert_allclose(one.p[k], two.p[k], atol=1e-6)


def test_each_window_is_learnt_once_a_pass(monkeypatch):
    monkeypatch.setattr(causal_lm, "BUFFER", 10)
    model = causal_lm.Model(np.append(np.random.default_rng(3).integers(1, 200, 80), [0, 12]))
    texts = [np.append(np.random.default_rng(n).integers(0, 80, n), 81) for n in (0, 5, 23, 24, 300, 100, 47)]
    windows, taken, rates = np.concatenate([causal_lm.windows_of(model, t) for t in texts]), Counter(), []

    def step(self, own, state, rate):
        taken.update(map(tuple, own.tolist()))
        rates.append(rate)

    monkeypatch.setattr(causal_lm.Model, "step", step)
    assert model.learn(iter(texts), 0.25, 0.75, len(windows), 3) == len(windows)
    assert taken == Counter({k: 3 * n for k, n in Counter(map(tuple, windows.tolist())).items()})
    assert rates == sorted(rates, reverse=True) and rates[0] == 0.75 * causal_lm.RATE


def test_attention_learns_from_every_text_however_they_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 60, 12).astype(np.uint16) for _ in range(1500)]

    def tables(rows, parts):
        df = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(rows)], "doc_id long, check long, ids binary")
        return causal_lm.train(df.repartition(parts)).p

    plain = tables(texts, 2)
    for k in (3, 700, 1401):  # the same ids in another order
        turned = tables([x[::-1] if j == k else x for j, x in enumerate(texts)], 2)
        assert any(np.abs(turned[name] - plain[name]).max() > 1e-6 for name in plain), k
    monkeypatch.setattr(causal_lm, "GROUP_IDS", 1500)
    one, two = tables(texts, 2), tables(texts[:], 5)
    assert np.abs(one["v"] - plain["v"]).max() > 1e-3
    for name in one:
        np.testing.assert_allclose(one[name], two[name], atol=1e-9)


def test_new_chunks_have_the_ids_of_the_library(monkeypatch):
    path = tokenizer_path(TOKENIZER)
    rng = random.Random(12)
    pieces = ["<", "|>", "e\u0301", "\u0301x", "\u212b", "it's", "a.b,", "1234", "\U0001f600", "startoftext", "ß.", "--"]
    texts = [" ".join(rng.choice(pieces) + rng.choice(["", "q", "Zo"]) * rng.randint(0, 3) for _ in range(40)) for _ in range(30)]
    for size in (1, 7, 256):
        monkeypatch.setattr(tokens, "JOINED", size)
        own = tokens.Encoder(path)
        assert own.mark is not None
        for with_mark in (own.mark, None):
            own.mark = with_mark
            own._clear()
            got = [ids[a:b].tolist() for _, _, ids, at in own.column(pa.array(texts)) for a, b in zip(at, at[1:])]
            assert got == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_gradients_agree_with_differences():
    model = causal_lm.Model(np.append(np.random.default_rng(3).integers(1, 200, 60), [0, 12]))
    windows = np.random.default_rng(4).integers(0, causal_lm.CLASSES, (1, causal_lm.WINDOW + 1))

    def loss():
        model._tables()
        logits, _ = model.logits(windows[:, :-1])
        logits = logits.astype(float)
        picked = np.take_along_axis(logits, windows[:, 1:, None], 2)[:, :, 0]
        return float((np.log(np.exp(logits).sum(2)) - picked).mean())

    before = loss()
    model.fit(np.repeat(windows, 4, 0), steps=40, batch=4)
    assert loss() < 0.5 * before


# ---- pipeline ----


def test_stages_take_effect_one_after_another(spark, documents, tmp_path):
    rng = random.Random(10)
    item = prose(rng, 40, 9000)
    clean = [(k, prose(rng, 60, 9000)) for k in range(200)]
    toxic = [(k, prose(rng, 30, 9000) + " grumblefoo blathermuck " + prose(rng, 10, 9000)) for k in range(200, 280)]
    copies = [(300, clean[0][1]), (301, clean[0][1].upper()), (302, clean[1][1] + " tail")]
    leaks = [(400, f"{prose(rng, 20, 9000)} {item} {prose(rng, 20, 9000)}")]
    private = [(500, f"{prose(rng, 20, 9000)} jo.doe@mail.example.com {prose(rng, 20, 9000)}")]
    rows = clean + toxic + copies + leaks + private
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 280)) for k, _ in rows if k < 280], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        names = docs.columns
        docs = base.save(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {k for k, _ in clean + copies + leaks + private}
    assert set(kept["ngram_jaccard_join"]) == {k for k, _ in clean + leaks + private}
    assert set(kept["benchmark_decontamination"]) == {k for k, _ in clean + private}
    assert "<EMAIL>" in kept["pii"][500] and {k: t for k, t in kept["pii"].items() if k != 500} == dict(clean)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == set(kept["pii"]) and final.where("offset + length > 4096").isEmpty()


def test_stages_with_empty_tables(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_folds_follow_the_keys_text(documents):
    rows = documents([(k, "") for k in range(50)] + [(None, "")]).select("doc_id", base.fold("doc_id", 5).alias("part")).collect()
    assert all(r.part == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in rows)


def test_numbers_are_gapless_per_key(documents):
    rows = documents([(k % 7, str(k)) for k in range(100)]).withColumn("odd", F.col("doc_id") % 2)
    got = base.number_rows(rows, "at", ["odd"], ["text"], ["text"], 5).collect()
    for odd in (0, 1):
        own = sorted(r["at"] for r in got if r.odd == odd)
        assert own == list(range(len(own)))
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
