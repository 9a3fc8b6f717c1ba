import random
import statistics

import pytest
from pyspark.sql import functions as F

from clipledger.operators.prefix import exact_median, interval_cells, interval_join, running, value_buckets, with_position, with_previous


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_positions_previous_and_running_values(frame, width):
    rng = random.Random(width)
    rows = [(f"k{rng.randint(0, 2)}", t, rng.randint(-9, 9)) for t in rng.sample(range(200), 120)]
    df = frame(rows, "k string, t int, v int")
    bucket = F.expr(f"t div {width}")
    placed = with_position(df, ["k"], [F.col("t")], bucket, "pos", "n")
    placed = {(r.k, r.t): (r.pos, r.n) for r in placed.collect()}
    previous = with_previous(df, ["k"], ["t"], bucket, ["v"])
    previous = {(r.k, r.t): r.previous and r.previous.v for r in previous.collect()}
    top = running(df, ["k"], [F.col("t")], bucket, {"m": ("max", F.col("v"), True), "s": ("sum", F.col("v"), False)})
    top = {(r.k, r.t): (r.m, r.s) for r in top.collect()}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        for i, (t, _) in enumerate(own):
            assert placed[key, t] == (i, len(own))
            assert previous[key, t] == (own[i - 1][1] if i else None)
            assert top[key, t] == (max(v for _, v in own[: i + 1]), sum(v for _, v in own[:i]))


def test_exact_median(frame):
    rng = random.Random(3)
    rows = [(f"k{i % 3}", rng.randint(0, 30) / 4) for i in range(100)]
    got = exact_median(frame(rows, "k string, v double"), ["k"], "v", F.floor("v"), "m")
    want = {k: statistics.median(v for kk, v in rows if kk == k) for k in ("k0", "k1", "k2")}
    assert {r.k: r.m for r in got.collect()} == want


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join(frame, closed):
    rng = random.Random(8)
    points = [(rng.randint(0, 1), i, float(rng.randint(0, 40))) for i in range(40)]
    spans = [(rng.randint(0, 1), i, float(s := rng.randint(0, 40)), float(s + rng.randint(0, 15))) for i in range(30)]
    joined = interval_join(
        frame(points, "k int, p int, t double"), frame(spans, "k int, s int, a double, b double"),
        ["k"], "t", "a", "b", 5.0, closed,
    )
    got = sorted((r.p, r.s) for r in joined.collect())
    assert got == sorted(
        (p, s) for k, p, t in points for kk, s, a, b in spans if k == kk and a <= t and (t <= b if closed else t < b)
    )


def contained(points, intervals, closed):
    return sorted((p[0], i[0]) for p in points for i in intervals if p[1] == i[1] and i[2] <= p[2] and (p[2] <= i[3] if closed else p[2] < i[3]))


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_matches_all_pairs_for_any_length(frame, closed):
    rng = random.Random(4)
    points = [(k, f"v{k % 3}", float(rng.choice([rng.randint(-50, 400), rng.randint(0, 10**9)]))) for k in range(300)]
    lengths = [0.0, 1.0, 59.5, 60.0, 61.0, 120.0, 1000.0, 3.2e7, 1e9, 1e25, float("inf")]
    intervals = [(k, f"v{k % 3}", float(rng.randint(-60, 300))) for k in range(99)]
    intervals = [(*x, x[2] + rng.choice(lengths)) for x in intervals] + [(99, "v0", float("-inf"), 5.0), (100, "v0", 9.0, 8.0)]
    left, right = frame(points, "p int, video string, t double"), frame(intervals, "i int, video string, a double, b double")
    got = interval_join(left, right, ["video"], "t", "a", "b", 60.0, closed)
    assert sorted((r.p, r.i) for r in got.select("p", "i").collect()) == contained(points, intervals, closed)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_interval_of_years_takes_a_few_cells(frame):
    rows = [(0, 0.0, 3.2e9), (1, 5.0, 9.0), (2, 50.0, 70.0), (3, 0.0, float("inf"))]
    cells = interval_cells(frame(rows, "i int, a double, b double"), "a", "b", 60.0).groupBy("i").count().collect()
    assert all(r["count"] <= 32 for r in cells) and len(cells) == 4
    assert interval_join(frame([(1, 2.0)], "p int, t double"), frame([], "i int, a double, b double"), [], "t", "a", "b", 60.0, True).count() == 0


def test_median_of_values_below_one_has_even_buckets(frame):
    rng = random.Random(8)
    rows = [("a", rng.random() / 1000 + 0.5) for _ in range(4000)] + [("a", 0.5)] * 700 + [("a", 1e9)]
    rows += [("b", float(rng.randint(0, 3))) for _ in range(101)] + [("c", 0.25), ("d", None)]
    df = frame(rows, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", None, "m").collect()}
    assert got == {k: statistics.median([v for x, v in rows if x == k]) for k in "abc"}
    counted = df.filter("v IS NOT NULL").groupBy("k", "v").count()
    sizes = [r["count"] for r in value_buckets(counted, ["k"], "v").filter("k = 'a'").groupBy("__share").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 4001 / 64
