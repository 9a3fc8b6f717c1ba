"""Toxicity, fingerprints, secrets, personal data and decontamination against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.llm import decontaminate, pii, secrets, syncmers, toxicity

WORDS = "the of and harbour lantern quiet meadow silver copper river stone winter bridge garden".split()
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (None, "no key"), (5, "twice"), (5, "twice"), (6, "é ñ 日本 😀 " * 3), (7, "long " * 30_000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- toxicity ----


def test_toxicity_learns_and_holds_out(spark, documents):
    rng = random.Random(5)
    rows = [(k, prose(rng, 40) + (" grumblefoo " if k % 4 == 0 else " ") + prose(rng, 10)) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    got = toxicity.score(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.5) for r in out)


def test_evidence_beyond_the_strongest_features_counts(spark, documents):
    rng = random.Random(6)
    insults = ["".join(rng.choice("bdfgjkpqvxyz") + rng.choice("aeiou") for _ in range(5)) for _ in range(40)]
    # one frequent word fills the list of features; the insults of the others are rarer
    mark = lambda k: "grumblefoo" if k % 8 == 0 else insults[rng.randrange(40)] if k % 4 == 0 else ""
    rows = [(k, f"{prose(rng, 40)} {mark(k)} {prose(rng, 10)}") for k in range(1600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(1600)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = toxicity.train(docs, labels, ~toxicity.held_out(), features=16)
    got = toxicity.score(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model).where("held_out").collect()
    hits = [r.predicted for r in got if r.doc_id % 8 == 4]
    assert sum(hits) >= 0.95 * len(hits) > 30
    assert all(r.predicted == int(r.doc_id % 8 == 0) for r in got if r.doc_id % 8 != 4)


def test_a_counted_text_scores_no_lower_than_the_same_text_not_counted(spark, documents):
    """Sums of weak evidence over n-grams of both halves never turn against it."""
    rng = random.Random(21)
    bad = [f"vile{k}" for k in range(60)]
    rows = [(k, prose(rng, 40) + (" " + " ".join(rng.sample(bad, 3)) if k % 4 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    docs, key = documents(rows), F.col("doc_id")
    every = toxicity.train(docs, labels, F.lit(True), features=16)
    some = toxicity.train(docs, labels, key % 20 != 0, features=16)
    assert (every.rest_weight >= 0).all() and every.rest_weight.any()
    of = lambda model: {r.doc_id: r.score for r in toxicity.score(docs.where(key % 20 == 0), model).collect()}
    counted, left_out = of(every), of(some)
    assert len(counted) == 30 and all(counted[k] >= left_out[k] - 0.02 for k in counted)


def test_toxicity_scores_ignore_other_columns_and_odd_rows(spark, documents):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(k, "bad words here" if k % 2 else "nice words here") for k in range(40)]
    model = toxicity.train(documents(rows), labels, F.lit(True))
    got = toxicity.score(documents(ODD, score="old", predicted="old", toxic=1), model)
    assert got.count() == len(ODD) and got.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(documents([]), model).count() == 0


def test_toxicity_without_labels_is_a_quarter(spark, documents):
    model = toxicity.train(documents([(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert [round(r.score, 6) for r in toxicity.score(documents([(1, "a b c")]), model).collect()] == [0.25]


def test_grams_stay_inside_their_text():
    alone, together = toxicity.grams(["abcdef"])[0], toxicity.grams(["abcdef", "ghi"])
    for order, one, both in zip(toxicity.ORDERS, alone, together[0]):
        assert one[: 7].tolist() == both[: 7].tolist()
        assert (one < 1 << toxicity.BITS).sum() == 6 - order + 1


# ---- fingerprints ----


def plain_anchors(text):
    """Every k-mer judged on its own, with hashes spelled out letter by letter."""
    whole = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    def rolled(part):
        if len(part) == 1:
            return (ord(part) + 1) * 0x9E3779B97F4A7C15 & whole
        middle, factor = len(part) // 2, 0xD6E8FEB86659FD93
        for _ in range(middle.bit_length() - 1):
            factor = factor * factor & whole
        return (rolled(part[:middle]) * factor + rolled(part[middle:])) & whole

    found, k, s = {}, syncmers.K, syncmers.S
    for i in range(len(text) - k + 1):
        inner = [mixed(rolled(text[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            value = mixed((inner[0] * 0x9E3779B97F4A7C15 + inner[-1]) & whole) >> 32
            found.setdefault(value, i)
    kept = sorted(found.items())
    return kept[: max(syncmers.ANCHORS, sum(x < syncmers.BOUND for x, _ in kept))]


def plain_likeness(a, b):
    """The longest common chain by a table over all pairs of anchors."""
    def complete(x):
        return 1 << 32 if len(x) < syncmers.ANCHORS else max(x[-1][0], syncmers.BOUND - 1)

    bound = min(complete(a), complete(b))
    a, b = ([x for x in y if x[0] <= bound] for y in (a, b))
    left, right = ([h for h, _ in sorted(x, key=lambda y: y[1])] for x in (a, b))
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    chain = table[-1][-1]
    return chain / max(1, len(a) + len(b) - chain)


def test_likeness_is_the_longest_common_chain_and_anchors_grow():
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (20, 300, 1500)]
    texts += [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts] + [texts[2][:4000] + texts[1] + texts[2][4000:]]
    found = syncmers.anchors(texts)
    plain = [plain_anchors(t) for t in texts]
    for i, x in enumerate(texts):
        assert [tuple(p) for p in found[i].tolist()] == plain[i]
        for j in range(len(texts)):
            if plain[i] and plain[j]:
                assert syncmers.likeness(found[i], found[j]) == pytest.approx(plain_likeness(plain[i], plain[j]))
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(20_000))
    assert len(syncmers.anchors([long])[0]) > len(long) / 150


def test_anchors_depend_on_their_kmer_alone():
    rng = random.Random(2)
    for text in (prose(rng, 30), "aaaa " * 20, "é日本" * 15):
        got = syncmers.anchors(["unrelated text before " * 3, text])[1]
        assert [tuple(x) for x in got.tolist()] == plain_anchors(text)


def test_likeness_bounds():
    rng = random.Random(3)
    a, b = prose(rng, 400), prose(random.Random(4), 400).upper()
    fa, fb, fe = syncmers.anchors([a, b, ""])
    assert syncmers.likeness(fa, fa) == 1.0 and syncmers.likeness(fe, fe) == 1.0
    assert syncmers.likeness(fa, fe) == 0.0 and syncmers.likeness(fa, fb) < 0.1
    half = syncmers.anchors([a[: len(a) // 2] + b[: len(b) // 2]])[0]
    assert 0.15 < syncmers.likeness(fa, half) < 0.6
    assert (syncmers.from_text(syncmers.as_text(fa)) == fa).all()


@pytest.mark.parametrize("stretch", [2, 1000])
def test_edited_texts_take_the_next_document(documents, stretch):
    rng = random.Random(9)
    rows = [(k * 3, prose(rng, rng.randint(0, 40))) for k in range(25)] + [(30, "tie two"), (7, None)]
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in syncmers.fingerprint_documents(documents(rows), stretch).collect()}
    order = sorted(((k, t or "") for k, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        r = got[key, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        own, changed, nxt = syncmers.anchors([text, edited, following])
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.as_text(own), syncmers.as_text(changed))
        assert r.near_next == syncmers.likeness(own, nxt) and r.near_edited == syncmers.likeness(own, changed)


def test_fingerprints_of_odd_rows(documents):
    rows = syncmers.fingerprint_documents(documents(ODD, fingerprint="old"), 2).collect()
    assert len(rows) == len(ODD)
    assert {base64.b64decode(r.fingerprint) for r in rows if r.n_chars == 0} == {b""}
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert syncmers.fingerprint_documents(documents([])).count() == 0
    assert syncmers.fingerprint_documents(documents([(None, "a"), (None, "b")])).count() == 2


# ---- secrets ----


def plain_secrets(text):
    word = "".join
    either = lambda x: word(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    rules = [(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(rules) for m in re.finditer(p, text) if len(m.group(g)) >= least)


def test_base_secrets_match_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "Token", "API_KEY", "api", "key", "=", " ", ":", '"', "'", "AKIA", "AKI", "A1B2C3D4E5F6", "0af3" * 9, "abcdef12", ".", "\n", "ſecret", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [x for x in secrets.find_secrets(text) if x[1] < secrets.BASE] == plain_secrets(text)


def test_ledger_scans_only_what_it_lacks(spark, documents):
    key = "token = abcdefgh12345"
    first = documents([(1, key), (2, key), (3, "nothing")]).select("doc_id", "text")
    found, ledger = secrets.scan_history(first)
    assert ledger.count() == 2
    assert {(r.doc_id, r.n_assign, r.spans) for r in found.collect()} == {(1, 1, "assign:0:21"), (2, 1, "assign:0:21"), (3, 0, "")}
    later = first.unionByName(documents([(4, key), (5, "AKIA" + "B" * 16)]).select("doc_id", "text"))
    found, new = secrets.scan_history(later, ledger)
    assert new.count() == 1 and found.count() == 5
    assert {r.doc_id for r in found.where("n_access = 1").collect()} == {5}
    # a job that appended its rows twice changes nothing
    found, new = secrets.scan_history(later, ledger.unionByName(ledger))
    assert new.count() == 1 and found.count() == 5


def test_a_changed_rule_scans_alone(monkeypatch, documents):
    rows = documents([(1, "token = abcdefgh12345 AKIA" + "B" * 16), (2, "nothing")]).select("doc_id", "text")
    found, ledger = secrets.scan_history(rows)
    before = {r.doc_id: r.spans for r in found.collect()}
    monkeypatch.setattr(secrets, "VERSIONS", ["changed", *secrets.VERSIONS[1:]])
    missing = secrets.unseen_blobs(rows, ledger).collect()
    assert [r.missing for r in missing] == [["changed"]] * 2
    found, new = secrets.scan_history(rows, ledger)
    assert {tuple(r.rules) for r in new.collect()} == {("changed",)}
    assert {r.doc_id: r.spans for r in found.collect()} == before


def test_secrets_of_odd_rows(documents):
    found, _ = secrets.scan_history(documents(ODD, spans="old", blob="old"))
    rows = found.collect()
    assert len(rows) == len(ODD) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan_history(documents([]))[0].count() == 0
    extra = "ghp_" + "Zz" * 18
    row = secrets.scan_history(documents([(1, extra)]))[0].first()
    assert row.spans == f"hosting:0:{len(extra)}" and row.base_sha256 == hashlib.sha256(b"").hexdigest()


# ---- personal data ----


def plain_personal(text):
    rules = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = k == 0
            good |= k == 1 and all(int(x) <= 255 for x in m.group().split("."))
            good |= k == 2 and 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            good |= k == 3 and 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rng = random.Random(4)
    parts = [*"0123456789", "@", ".", "+", "-", " ", "(", ")", "a", "b.c", "%", "4111 1111 1111 1111", "4111111111111111", "192.168.1.1", "+1 (988) 555-2485", "é", "\n", "a@b.c", "000"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(text) == plain_personal(text)


def test_base_spans_are_linear_in_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "1." * 50_000, "+1" * 50_000, "a@" * 50_000):
        assert len(pii.base_spans(text)) <= len(text) // 8


def test_skip_links_carry_a_label_to_a_repeated_number(documents):
    text = "reach me at +1 (988) 555-2485 today , again 555-2485 and 2031 or room 12"
    filler = [(k, f"call +1 (9{k:02d}) 5{k:02d}-2{k:03d} or mail user{k}@mail{k}.example.com now") for k in range(10, 60)]
    docs = documents([(1, text), *filler])
    row = pii.detect_all(docs).where("doc_id = 1").first()
    again = text.rindex("555-2485")
    assert row.n_phone == 1 and row.spans.split(",")[1:] == [f"phone:{again}:{again + 8}"]
    masked = {r.doc_id: r.text for r in pii.mask(docs, pii.train(docs)).collect()}
    assert masked[1] == "reach me at <PHONE> today , again <PHONE> and 2031 or room 12"


def test_messages_on_a_tree_give_exact_marginals():
    field = pii.Field()
    for shape, label in ((1, -1), (2, 4), (3, -1)):
        field._node(0, shape, label, 0, 1)
    field.chain, field.skip = [(0, 1)], [(1, 2)]
    rng = np.random.default_rng(1)
    model = pii.Model(rng.integers(0, 9, (pii.SHAPES + 1) * pii.LABELS), rng.integers(0, 9, pii.LABELS**2), rng.integers(0, 9, pii.LABELS**2))
    joint = np.zeros((pii.LABELS, pii.LABELS))
    for a in range(pii.LABELS):
        for c in range(pii.LABELS):
            joint[a, c] = np.exp(model.own[1, a] + model.chain[a, 4] + model.skip[4, c] + model.own[3, c])
    joint /= joint.sum()
    got = model.beliefs(field)
    np.testing.assert_allclose(got[0], joint.sum(1), atol=0.02)
    np.testing.assert_allclose(got[2], joint.sum(0), atol=0.02)


def test_a_label_reaches_every_repeat():
    field = pii.Field()
    field.add(0, "+1-988-555-2485" + " and once more 555-2485 then" * 40, [(0, 3, 15)])
    model = pii.Model(*(np.zeros(n, int) for n in ((pii.SHAPES + 1) * pii.LABELS, pii.LABELS**2, pii.LABELS**2)))
    model.own[:, :] = [0, -20, -20, -20, -5.3]
    model.chain = np.zeros((pii.LABELS, pii.LABELS))
    model.skip = np.where(np.eye(pii.LABELS) > 0, 5.5, -4.6)
    model.skip[0, 0] = 0
    repeats = [k for k, x in enumerate(field.words) if x[1] > 0]
    assert len(repeats) == 40 and model.beliefs(field)[repeats, 4].min() > 0.9
    assert pii.tie("(10.0.0.1),") == "10.0.0.1" and pii.tie("1.2.3.4") != pii.tie("1.2.3.5") and pii.tie("12") == ""


def test_messages_along_paths_are_exact():
    rng = np.random.default_rng(5)
    pair = rng.normal(0, 3, (pii.LABELS, pii.LABELS))
    pair += pair.T
    own, step = rng.normal(0, 4, (46, pii.LABELS)), np.concatenate([np.arange(n) for n in (2, 37, 1, 6)])
    got = pii.along(own, step, pair)
    for a, b in ((0, 2), (2, 39), (39, 40), (40, 46)):
        for way in (range(a, b), range(b - 1, a - 1, -1)):
            before = np.zeros(pii.LABELS)
            for t in way:
                got[t] -= before
                before = np.logaddexp.reduce((own[t] + before)[:, None] + pair, axis=0)
    np.testing.assert_allclose(got - got.max(1, keepdims=True), 0, atol=1e-9)


def test_long_runs_of_ties_and_chains_settle():
    field = pii.Field()
    for k in range(400):
        field._node(k // 200, 1 + k % 3, 4 if k in (0, 250) else -1, 0, 1)
    field.chain = [(k, k + 1) for k in range(399) if k != 199]
    field.skip = [(k, k + 5) for k in range(395) if k // 200 == (k + 5) // 200]
    rng = np.random.default_rng(1)
    own = np.tile([900, 2, 1, 3, 40], pii.SHAPES + 1)
    model = pii.Model(own, rng.integers(1, 9, pii.LABELS**2), 30 * np.eye(pii.LABELS, dtype=int).ravel())
    got = model.beliefs(field)
    alone = pii.Field()
    alone.shapes, alone.label, alone.words = field.shapes[:200], field.label[:200], field.words[:200]
    alone.chain, alone.skip = ([e for e in x if e[1] < 200] for x in (field.chain, field.skip))
    np.testing.assert_allclose(model.beliefs(alone), got[:200], atol=1e-3)
    assert np.isfinite(got).all() and np.allclose(got.sum(1), 1)


def test_personal_data_of_odd_rows(documents):
    rows = pii.detect_all(documents(ODD, spans="old", n_email=4)).collect()
    assert len(rows) == len(ODD) and {r.spans for r in rows} == {""}
    assert pii.detect_all(documents([])).count() == 0
    kept = pii.mask(documents(ODD), pii.train(documents(ODD))).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(k), str(t)) for k, t in ODD)


# ---- decontamination ----


def test_alignment_matches_a_plain_table():
    rng = random.Random(1)
    cases = [([rng.randint(2, 6) for _ in range(rng.randint(1, 25))], [rng.randint(2, 6) for _ in range(rng.randint(1, 12))]) for _ in range(200)]

    def best(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
        return max(map(max, table))

    got = decontaminate.align([np.array(a, np.uint64) for a, _ in cases], [np.array(b, np.uint64) for _, b in cases]).tolist()
    for (a, b), (score, first, end) in zip(cases, got):
        assert score == best(a, b) == best(a[first:end], b)


def test_exact_edited_and_clean_texts(spark, documents):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(3000)]
    items = [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(12)]
    edited = items[1].split()
    for k in range(4, 40, 6):
        edited[k] = "changed"
    del edited[20]
    fill = lambda: " ".join(rng.choice(pool) for _ in range(60))
    rows = [(0, f"{fill()} {items[0].upper()}, {fill()}"), (1, f"{fill()} {' '.join(edited)} {fill()}"), *((k, fill()) for k in range(2, 30))]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    for block in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(rows), benchmark, block=block).collect()}
        assert set(got) == {(0, 0), (1, 1)}
        assert got[0, 0].likeness == 1.0 and (got[0, 0].first_word, got[0, 0].end_word) == (60, 100)
        assert 0.5 < got[1, 1].likeness < 0.9
        assert {r.doc_id for r in decontaminate.drop_contaminated(documents(rows), benchmark, block=block).collect()} == set(range(2, 30))


def test_copies_of_an_item_dont_hide_each_other(spark, documents):
    item = [f"w{k}" for k in range(40)]
    edited = [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    stretched = [x for w in item for x in (w, "so")]  # no two words of the item are neighbours
    rows = [(0, item), (1, edited), (2, stretched), (3, item[:7]), *((k, item[:20]) for k in range(10, 60))]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = documents([(k, " ".join(["before", *x, "after"])) for k, x in rows])
    got = {r.doc_id: round(r.likeness, 4) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {0: 1.0, 1: 0.6375, 2: 0.5125, **{k: 0.5 for k in range(10, 60)}}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == [3]


@pytest.mark.parametrize("common", [decontaminate.COMMON, 1])
def test_passages_lose_no_alignment(monkeypatch, common):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 20))) for _ in range(30)]
    items = decontaminate.Items(list(range(30)), texts)
    rows = []
    for _ in range(150):
        own = []
        for w in rng.choice(texts).split():
            own += [[w], [w], [w], ["zz"], [], ["yy", w], [w, "xx"]][rng.randint(0, 6)]
        rows.append(" ".join([rng.choice("abcdefgh") for _ in range(30)] + own + [rng.choice("abcdefgh") for _ in range(30)]))
    got = {x[:2]: x[2] for x in decontaminate.contaminations(items, decontaminate.pa.array(rows), 0.4)}
    whole = [decontaminate.words(*x[2:])[0] for r in rows for x in decontaminate.slices(decontaminate.pa.array([r]))]
    every = [(r, k) for r in range(150) for k in range(30)]
    score = decontaminate.align([whole[r] for r, _ in every], [items.words[k] for _, k in every])[:, 0]
    want = {p: s / (2 * len(items.words[p[1]])) for p, s in zip(every, score.tolist())}
    assert got == {p: x for p, x in want.items() if x >= 0.4} and len(got) > 100


def test_decontamination_of_odd_rows(spark, documents):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [*ODD, (None, "one two three four five six"), (8, "one two three four five six"), (8, "one two three four five six")]
    got = decontaminate.contaminated(documents(rows, item_id=4, likeness="old"), benchmark).collect()
    assert sorted(str(r.doc_id) for r in got) == ["8", "8", "None"]
    assert decontaminate.drop_contaminated(documents(rows), benchmark).count() == len(ODD)
    short = spark.createDataFrame([(1, "X"), (2, "no key."), (3, "no")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.likeness) for r in decontaminate.contaminated(documents(ODD), short).collect()} == {(4, 1, 1.0), (None, 2, 1.0)}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(rows), empty).count() == 0
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
