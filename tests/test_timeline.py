import random

import pytest
from pyspark.sql import functions as F

from clipledger.operators import conflicts
from clipledger.operators import timeline as tl
from clipledger.operators.windows import assign_windows, plan_windows

VIDEO = "video_id string, duration_seconds double, fps double, frame_count bigint"
CLAIM = (
    "window_id string, pos int, player_id string, source_track_id string, global_track_id string, "
    "event string, confidence double, temporal_score double, start_time double, end_time double"
)
CAND = (
    "candidate_id string, source_video_id string, window_id string, local_track_id string, "
    "global_track_id string, event string, confidence double, temporal_score double, "
    "local_start_seconds double, local_end_seconds double, global_start_seconds double, global_end_seconds double"
)


def claim(window, pos, player, event, start, end, confidence=0.9):
    return (window, pos, player, None, None, event, confidence, None, start, end)


def test_plan_windows_with_overlap(frame):
    rows = plan_windows(frame([("v", 30.0, 30.0, 900)], VIDEO)).orderBy("index").collect()
    assert [(r.start_seconds, r.end_seconds) for r in rows] == [(0, 12), (10, 22), (20, 30)]
    assert [(r.source_start_frame, r.source_end_frame) for r in rows] == [(0, 360), (300, 660), (600, 900)]
    assert rows[0].segment_id == "v_00000"


def test_short_tail_joins_previous_window(frame):
    rows = plan_windows(frame([("v", 21.0, 30.0, 630)], VIDEO), 10, 0, 3).orderBy("index").collect()
    assert [(r.start_seconds, r.end_seconds) for r in rows] == [(0, 10), (10, 21)]
    assert rows[-1].source_end_frame == 630


def stepwise_plan(duration, window, overlap, tail):
    """Direct restatement: advance until the video ends."""
    spans, start = [], 0.0
    while start < duration:
        end = min(start + window, duration)
        if spans and end - start < tail:
            spans[-1] = (spans[-1][0], duration)
            break
        spans.append((start, end))
        if end >= duration:
            break
        start += window - overlap
    return spans


def test_plan_and_assignment_match_stepwise_plan(spark, frame):
    rng = random.Random(5)
    for window, overlap, tail in ((12, 2, 2), (10, 0, 3), (8, 3, 5), (6, 1, 6)):
        videos = [(f"v{i}", float(rng.randint(1, 60)), 10.0, 600) for i in range(40)]
        df = frame(videos, VIDEO)
        got = {}
        for r in plan_windows(df, window, overlap, tail).orderBy("source_video_id", "index").collect():
            got.setdefault(r.source_video_id, []).append((r.start_seconds, r.end_seconds))
        want = {v[0]: stepwise_plan(v[1], window, overlap, tail) for v in videos}
        assert got == want
        points = [(i, v[0], rng.randint(0, 70) / 1.0) for i, v in enumerate(videos * 3)]
        placed = assign_windows(
            frame(points, "id int, video_id string, t double"), df, "t", window, overlap, tail
        )
        found = {(r.id, r.window_index) for r in placed.collect()}
        assert found == {
            (i, k) for i, v, t in points for k, (s, e) in enumerate(want[v]) if s <= t < e
        }


def test_bad_parameters_are_refused(frame):
    for args in ((0, 0, 0), (5, 5, 0), (5, 1, 6)):
        with pytest.raises(ValueError):
            plan_windows(frame([("v", 30.0, 30.0, 900)], VIDEO), *args)
    with pytest.raises(ValueError):
        tl.mark_islands(frame([], CAND), gap=-1)


def windows_12_10(frame):
    return plan_windows(frame([("v", 30.0, 30.0, 900)], VIDEO))


def test_overlapping_windows_become_one_event(frame):
    videos = frame([("v", 30.0, 30.0, 900)], VIDEO)
    claims = frame(
        [
            claim("v_00000", 0, "player_3", "Made Shot", 10.2, 11.8),
            claim("v_00001", 0, "player_7", "Made Shot", 0.1, 1.9),
            claim("v_00001", 1, "player_7", "blank", 0.1, 1.9),
        ],
        CLAIM,
    )
    built = tl.build_timeline(windows_12_10(frame), claims, videos)
    candidates = built["candidates"].orderBy("global_start_seconds").collect()
    assert len(candidates) == 2
    assert candidates[0].global_start_seconds == pytest.approx(10.1)
    assert candidates[0].temporal_score == 0.9
    (event,) = built["events"].collect()
    assert event.track_references == ["v_00001/player_7", "v_00000/player_3"]
    (draft,) = built["material_drafts"].collect()
    assert (draft.start_seconds, draft.end_seconds) == (pytest.approx(5.1), pytest.approx(13.9))
    assert draft.material_id == "v:material_00000"


def test_two_tracks_of_one_window_stay_apart(frame):
    claims = frame(
        [
            claim("v_00000", 0, "player_1", "Rebound", 3.0, 4.0),
            claim("v_00000", 1, "player_2", "Rebound", 3.2, 4.1),
        ],
        CLAIM,
    )
    candidates, _ = tl.collect_candidates(windows_12_10(frame), claims)
    assert tl.merge_candidates(candidates).count() == 2


def test_padding_is_clamped_to_the_video(frame):
    videos = frame([("v", 6.0, 30.0, 180)], VIDEO)
    claims = frame([claim("v_00000", 0, "player_1", "ast", 0.2, 1.0)], CLAIM)
    (draft,) = tl.build_timeline(plan_windows(videos), claims, videos)["material_drafts"].collect()
    assert (draft.start_seconds, draft.end_seconds, draft.pre_roll_seconds) == (0.0, 3.0, 7.0)


def test_empty_range_stops_or_is_set_apart(frame):
    claims = frame([claim("v_00000", 0, "player_1", "Foul", 4.0, 3.0)], CLAIM)
    with pytest.raises(Exception, match="empty event range"):
        tl.collect_candidates(windows_12_10(frame), claims)[0].collect()
    good, rejected = tl.collect_candidates(windows_12_10(frame), claims, strict=False)
    assert good.count() == 0 and rejected.count() == 1


def greedy(candidates, gap):
    """Direct restatement of the merge rule over one list of candidates."""
    groups = []
    for c in sorted(candidates, key=lambda c: (c[1], c[10], c[5], c[2], c[3], c[0])):
        for g in reversed(groups):
            if (
                g["video"] == c[1]
                and g["event"] == c[5]
                and c[10] <= g["end"] + gap
                and c[11] >= g["start"] - gap
                and g["tracks"].get(c[2], c[3]) == c[3]
                and (c[4] is None or not g["known"] or c[4] in g["known"])
            ):
                break
        else:
            g = {"video": c[1], "event": c[5], "start": c[10], "end": c[11], "tracks": {}, "known": set(), "ids": []}
            groups.append(g)
        g["end"] = max(g["end"], c[11])
        g["tracks"][c[2]] = c[3]
        if c[4] is not None:
            g["known"].add(c[4])
        g["ids"].append(c[0])
    numbers, out = {}, []
    for g in groups:
        n = numbers[g["video"]] = numbers.get(g["video"], -1) + 1
        out.append((f"{g['video']}:event_{n:05d}", tuple(g["ids"])))
    return out


def random_candidates(seed, n, known_ids):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        video, window = f"v{rng.randint(0, 2)}", rng.randint(0, 20)
        start = float(window * 10 + rng.randint(0, 20)) / 2
        end = start + rng.randint(1, 6) / 2
        known = rng.choice([None, None, "a", "b"]) if known_ids else None
        rows.append(
            (f"c{i:03d}", video, f"{video}_{window:05d}", f"player_{rng.randint(0, 2)}", known,
             rng.choice(["Foul", "Rebound"]), 0.5, 0.5, 0.0, 1.0, start, end)
        )
    return rows


@pytest.mark.parametrize("seed,known", [(1, False), (2, True), (3, True)])
@pytest.mark.parametrize("bucket", [2.0, 3600.0])
def test_merge_matches_plain_greedy_rule(frame, seed, known, bucket):
    rows = random_candidates(seed, 250, known)
    merged = tl.merge_candidates(frame(rows, CAND), 0.5, bucket).collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in merged) == sorted(greedy(rows, 0.5))


def test_islands_equal_merge_without_conflicts(frame):
    rows = [r[:3] + ("player_0", None) + r[5:] for r in random_candidates(9, 200, False)]
    fast = tl.merge_islands(frame(rows, CAND), 0.5, 3.0).select("event_id", "candidate_ids").collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in fast) == sorted(greedy(rows, 0.5))


def test_temporal_events_are_validated_and_active(frame):
    raw = frame(
        [
            ("v", "player_1", "Assist", "0.8", "5.0", "6.5"),
            ("v", "player_0", "Made Shot", "0.9", "2.0", "4.0"),
            ("v", "player_0", "invalid", None, "4.0", "3.0"),
            ("v", "player_0", " ", "1", "4.0", "5.0"),
            ("v", "player_0", "Foul", "x", "4.0", "5.0"),
        ],
        "video_id string, player_id string, event string, confidence string, start_time string, end_time string",
    )
    events = tl.normalize_temporal_events(raw)
    assert [r.event for r in events.orderBy("sort_key").collect()] == ["Made Shot", "Assist"]
    active = tl.active_events(events, frame([("v", 3.0), ("v", 4.0)], "video_id string, t double"))
    assert [(r.t, r.event) for r in active.collect()] == [(3.0, "Made Shot")]


def test_candidate_plan_has_no_nested_loop(spark, frame):
    raw = frame([("v", 1.0, 2.0)], "video_id string, start_time double, end_time double")
    plan = tl.active_events(raw, frame([("v", 3.0)], "video_id string, t double"))
    text = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert F is not None


def crowded_candidates(seed, video, n=40):
    """Claims of one video whose islands span many segments, with conflicts of both kinds."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        window = rng.randint(0, 12)
        start = float(window * 8 + rng.randint(0, 20)) / 2
        known = rng.choice([None, None, None, "a", "b"])
        rows.append(
            (f"{video}c{i:03d}", video, f"{video}_{window:05d}", f"player_{rng.randint(0, 2)}", known,
             "Foul", 0.5, 0.5, 0.0, 1.0, start, start + rng.choice([1, 2, 3, 3, 30]) / 2)
        )
    return rows


def test_segments_match_the_ordered_rule_on_many_videos(frame):
    """1,000 videos, each an own random case, cut into segments of five seconds."""
    rows = [r for k in range(1000) for r in crowded_candidates(k, f"v{k:04d}")]
    merged = tl.merge_candidates(frame(rows, CAND), 0.5, 7.0, segment_seconds=5.0).collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in merged) == sorted(greedy(rows, 0.5))


def test_one_island_runs_in_many_tasks(spark, frame):
    """A group of one name reaches over all segments, others open and close on the way."""
    rows = []
    for i in range(600):
        track = "player_0" if i % 2 else f"player_{1 + i % 3}"
        rows.append((f"c{i:04d}", "v", f"v_{i // 2:05d}", track, None, "Foul", 0.5, 0.5, 0.0, 1.0, i / 2, i / 2 + 1.0))
    marked = tl.mark_islands(frame(rows, CAND), 0.5)
    assert marked.select("island").distinct().count() == 1
    keys = [*tl.GROUP, "island"]
    told = conflicts.assign_groups(marked, keys, tl.ORDER, 0.5, 10.0)
    assert {r["__group"] for r in told.select("__group").collect()} >= {"c0000", "c0001"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one task
    try:
        spans = marked.groupBy(*keys).agg(F.min("global_start_seconds").alias("__begin"))
        dealt = conflicts._dealt(conflicts.with_segments(marked, spans, keys, 10.0), None, keys, tl.ORDER)
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    merged = tl.merge_candidates(frame(rows, CAND), 0.5, 7.0, segment_seconds=10.0).collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in merged) == sorted(greedy(rows, 0.5))


def test_frontier_forgets_closed_groups_and_past_windows():
    groups = conflicts.OpenGroups(0.5)
    for i in range(1000):
        groups.place(f"c{i}", f"w{i}", float(i), "p", None, float(i), i + 1.0)
    state, refs = groups.frontier(1000.0)
    assert refs == ["c0"] and len(state) < 60 and len(groups.groups[0]["tracks"]) <= 1
    again = conflicts.OpenGroups(0.5, state)
    assert again.place("c1000", "w1000", 1000.0, "p", None, 1000.0, 1001.0) == 0
    assert again.place("x", "w1000", 1000.0, "q", None, 1000.2, 1001.0) == "x"
    assert again.frontier(1002.0)[1] == []
