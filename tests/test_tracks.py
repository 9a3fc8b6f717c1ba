import random

from pyspark.sql import functions as F

from clipledger.operators import tracks as tr
from clipledger.operators import windows as win

BOX = "clip_id string, track_id string, frame int, x double, y double, w double, h double"


def boxes(frame, tracks, clip="c"):
    rows = []
    for track, trajectory in tracks.items():
        for i, b in enumerate(trajectory):
            rows.append((clip, track, i, *([float(v) for v in b] if b else [None] * 4)))
    return frame(rows, BOX)


def test_prepare_keeps_players_and_picks_one_ball(frame):
    raw = boxes(
        frame,
        {
            "player_0": [[1, 1, 4, 4], None],
            "player_1": [[1, 1, -1, 4]],
            "player_2": [[1, 1, 4, 4]],
            "ball_1": [[1, 1, 2, 2], None],
            "ball_2": [[1, 1, 2, 2], [2, 2, 2, 2]],
        },
    )
    prepared = tr.prepare_tracks(raw)
    rows = {r.track_id: r for r in prepared.collect()}
    assert sorted(rows) == ["ball", "player_0", "player_2"]
    assert rows["ball"].source_track_id == "ball_2"
    assert rows["player_0"].identity_status == "unresolved"
    (report,) = tr.track_report(prepared).collect()
    assert (report.player_count, report.player_ids, report.selected_ball_track_id) == (2, ["player_0", "player_2"], "ball_2")


def test_ball_tie_goes_to_the_larger_text_and_no_ball_is_empty(frame):
    tied = boxes(frame, {"ball_9": [[1, 1, 2, 2]], "ball_10": [[1, 1, 2, 2]]})
    assert tr.prepare_tracks(tied).collect()[0].source_track_id == "ball_9"
    none = boxes(frame, {"player_1": [[1, 1, 2, 2]] * 5})
    ball = [r for r in tr.prepare_tracks(none).collect() if r.track_id == "ball"][0]
    assert (ball.source_track_id, ball.n_frames, ball.valid_bbox_count) == (None, 5, 0)


def greedy_matches(raw, clean, sources):
    """Direct restatement: clean ids in order claim a single free candidate."""
    claimed, out = set(), {}
    for name in sorted(clean):
        source = sources.get(name)
        if source is not None:
            candidates = [source] if source in raw else []
        else:
            candidates = sorted(r for r in raw if raw[r] == clean[name])
        free = [c for c in candidates if c not in claimed]
        if len(free) == 1:
            claimed.add(free[0])
            out[name] = ("matched", free[0])
        else:
            out[name] = ("unmatched" if not candidates else "ambiguous", None)
    return out


def run_match(frame, clips):
    raw_rows, clean_rows, clean_tracks = [], [], []
    for clip, (raw, clean, sources) in clips.items():
        for rows, tracks in ((raw_rows, raw), (clean_rows, clean)):
            for name, values in tracks.items():
                rows += [(clip, name, i, float(v), 1.0, 2.0, 2.0) for i, v in enumerate(values)]
        clean_tracks += [(clip, name, sources.get(name)) for name in clean]
    return tr.match_tracks(
        frame(clean_tracks, "clip_id string, track_id string, source_track_id string"),
        frame(clean_rows, BOX),
        frame(raw_rows, BOX),
    )


def test_matching_follows_the_sequential_claims(frame):
    rng = random.Random(4)
    clips = {}
    for n in range(60):
        shapes = [[rng.randint(0, 2)] for _ in range(3)]
        raw = {f"player_{i}": rng.choice(shapes) for i in range(rng.randint(1, 5))}
        clean = {f"player_{i}": rng.choice(shapes) for i in range(rng.randint(1, 6))}
        sources = {c: f"player_{rng.randint(0, 6)}" for c in clean if rng.random() < 0.5}
        clips[f"c{n}"] = (raw, clean, sources)
    got = {}
    for r in run_match(frame, clips).collect():
        got.setdefault(r.clip_id, {})[r.clean_track_id] = (r.status, r.raw_track_id)
    assert got == {c: greedy_matches(*args) for c, args in clips.items()}


def test_identical_raw_tracks_are_ambiguous(frame):
    matches = run_match(frame, {"c": ({"player_1": [7], "player_2": [7]}, {"player_0": [7]}, {})})
    (row,) = matches.collect()
    assert (row.status, row.candidate_count) == ("ambiguous", 2)
    raw = frame([("c", f"player_{i}", 0, 7.0, 1.0, 2.0, 2.0) for i in (1, 2)], BOX)
    members = tr.candidate_groups(raw).filter(F.col("candidate_group") == row.candidate_group)
    assert sorted(r.raw_track_id for r in members.collect()) == ["player_1", "player_2"]


def test_a_match_needs_one_join_and_few_sorts(frame):
    matches = run_match(frame, {"c": ({"player_1": [7], "player_2": [7]}, {"player_0": [7]}, {"player_0": "player_2"})})
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1


def test_later_claims_of_a_source_and_tracks_without_boxes(frame):
    clips = {"c": ({"player_1": [7], "player_2": [7], "player_3": [9]}, {"player_0": [7], "player_4": [7], "player_5": [7], "player_6": [8]}, {"player_0": "player_1", "player_5": "player_1", "player_6": "player_8"})}
    got = {r.clean_track_id: (r.status, r.raw_track_id, r.candidate_count) for r in run_match(frame, clips).collect()}
    assert got == {
        "player_0": ("matched", "player_1", 1), "player_4": ("matched", "player_2", 2),
        "player_5": ("ambiguous", None, 1), "player_6": ("unmatched", None, 0),
    }


def test_ball_matches_by_trajectory(frame):
    raw = boxes(frame, {"ball_1": [[1, 1, 4, 4]], "ball_2": [[8, 8, 5, 5]]})
    clean = boxes(frame, {"ball": [[8, 8, 5, 5]]})
    tracks = frame([("c", "ball", None)], "clip_id string, track_id string, source_track_id string")
    (row,) = tr.match_ball(tracks, clean, raw).collect()
    assert (row.status, row.raw_track_id) == ("matched", "ball_2")


def test_masking_is_inclusive_and_refuses_bad_ranges(frame):
    raw = boxes(frame, {"player_4": [[i, 0, 5, 5] for i in range(6)]})
    segments = frame(
        [("c", "player_4", "player_0", 2, 4), ("c", "player_4", "player_1", 2, 9), ("c", "player_8", "player_2", 0, 1)],
        "clip_id string, raw_track_id string, output_track_id string, start_frame int, end_frame int",
    )
    masked, audit = tr.mask_segment(raw, segments)
    rows = masked.orderBy("frame").collect()
    assert [r.frame for r in rows if r.x is not None] == [2, 3, 4] and len(rows) == 6
    status = {r.output_track_id: r.status for r in audit.collect()}
    assert status == {"player_0": "ok", "player_1": "range_exceeds_track", "player_2": "missing_track"}


def test_short_tracks_keep_every_frame_once(frame):
    raw = boxes(frame, {"player_1": [[0, 0, 5, 5], None, [0, 0, 5, 5], [0, 0, 5, 5], [0, 0, 1, 5]]})
    rows = win.uniform_sample(raw, 10).orderBy("frame").collect()
    assert [(r.frame, r.image_index) for r in rows] == [(0, 1), (2, 2), (3, 3)]
    assert [r.frame for r in win.uniform_sample(raw, 1).collect()] == [0]


def test_sample_can_be_limited_to_tracks(frame):
    raw = boxes(frame, {"player_1": [[0, 0, 5, 5]], "player_2": [[0, 0, 5, 5]]})
    only = frame([("c", "player_2")], "clip_id string, track_id string")
    assert [r.track_id for r in win.uniform_sample(raw, 3, tracks=only).collect()] == ["player_2"]


def test_out_of_range_frames_are_clamped_or_masked(frame):
    raw = boxes(frame, {"player_1": [[1, 2, 3, 4], [5, 6, 7, 8]]})
    frames = frame([("c", 0, -1), ("c", 1, 1), ("c", 2, 9)], "clip_id string, out_index int, frame int")
    stats = tr.track_statistics(raw)
    clamp = tr.project_boxes(frames, stats, raw, 2.0, 1.0, "clamp").orderBy("out_index").collect()
    assert [(r.b0, r.b2, r.valid) for r in clamp] == [(2.0, 8.0, 1.0), (10.0, 24.0, 1.0), (10.0, 24.0, 1.0)]
    null = tr.project_boxes(frames, stats, raw, 2.0, 1.0, "null").orderBy("out_index").collect()
    assert [r.valid for r in null] == [0.0, 1.0, 0.0]


def test_densified_tracks_are_renumbered(frame):
    rows = [("c", "player", 7, 0, 1, 1, 1, 1), ("c", "player", 3, 2, 1, 1, 1, 1), ("c", "ball", 5, 1, 1, 1, 1, 1)]
    dense = tr.densify_tracks(
        frame(rows, "clip_id string, kind string, object_id int, frame int, x int, y int, w int, h int")
    )
    got = {}
    for r in dense.orderBy("frame").collect():
        got.setdefault(r.track_id, []).append(r.x)
    assert got == {"player_0": [None, None, 1], "player_1": [1, None, None], "ball_1": [None, 1, None]}


def test_farther_from_the_window_edge_wins(frame):
    raw = boxes(frame, {"player_1": [[1, 1, 5, 5]] * 10}, "w1").union(boxes(frame, {"player_2": [[2, 2, 5, 5]] * 10}, "w2"))
    refs = frame(
        [("e", 0, "w1", "player_1", 0.0, 12.0, 10), ("e", 1, "w2", "player_2", 10.0, 22.0, 10)],
        "event_id string, ref_pos int, window_id string, track_id string, window_start double, window_end double, n_frames int",
    )
    times = frame([("e", 10.5), ("e", 11.5), ("e", 11.0), ("e", 40.0)], "event_id string, t double")
    got = {r.t: r.reference for r in tr.bbox_at_time(times, refs, raw, 12.0).collect()}
    assert got == {10.5: "w1/player_1", 11.5: "w2/player_2", 11.0: "w1/player_1", 40.0: None}


def test_a_grid_of_frames_is_never_broadcast(spark):
    materials = spark.sql("SELECT 'm' AS material_id, 'e' AS event_id, 0D AS start_seconds, 30D AS end_seconds")
    references = spark.sql(
        "SELECT 'e' AS event_id, 0 AS ref_pos, 'w' AS window_id, 'player_1' AS track_id, 10D AS window_start, 20D AS window_end, 20 AS n_frames"
    )
    shown = spark.sql("SELECT 'w' AS clip_id, 'player_1' AS track_id, id AS frame, 1D AS x, 1D AS y, 4D AS w, 4D AS h FROM range(10)")
    covered = tr.actor_coverage(materials, references, shown, 2.0, 60.0)
    # frames 0 to 9 of 20 lie between seconds 10 and 15
    assert [tuple(r) for r in covered.collect()] == [("m", 60, 10)]
    grid = tr.time_grid(materials, 2.0)
    for joined in (covered, tr.bbox_at_time(grid, references, shown, 60.0).filter("reference IS NOT NULL")):
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=merge") >= 2, plan


def test_a_ball_meets_its_source_once(frame):
    box = "clip_id string, track_id string, frame int, x double, y double, w double, h double"
    raw = frame([(c, t, 0, 1.0, 1.0, w, 1.0) for c, t, w in (("a", "ball_1", 1.0), ("a", "ball_2", 2.0), ("b", "ball_1", 1.0), ("c", "ball_1", 3.0))], box)
    clean = frame([("a", "ball", "ball_2"), ("b", "ball", "gone"), ("c", "ball", None), ("d", "ball", None)], "clip_id string, track_id string, source_track_id string")
    boxes = frame([("b", "ball", 0, 1.0, 1.0, 1.0, 1.0), ("c", "ball", 0, 1.0, 1.0, 9.0, 1.0)], box)
    matched = tr.match_ball(clean, boxes, raw)
    assert sum(line.strip(" :+-").startswith("Join") for line in matched._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 4
    rows = {r.clip_id: (r.status, r.method, r.raw_track_id, r.candidate_count) for r in matched.collect()}
    assert rows == {
        "a": ("matched", "source_track_id", "ball_2", 1), "b": ("matched", "trajectory_signature", "ball_1", 1),
        "c": ("unmatched", "trajectory_signature", None, 0), "d": ("unmatched", "trajectory_signature", None, 0),
    }
