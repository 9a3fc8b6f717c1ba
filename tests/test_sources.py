import json
import os

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipledger.functions import text as fn
from clipledger.operators.hooks import score_with
from clipledger.operators.windows import plan_windows
from clipledger.plans import all_queries
from clipledger.sources import documents as doc
from clipledger.sources import files as fl
from clipledger.sources import sinks
from clipledger.sources import tables as tb
from clipledger.streaming.incremental import process_new_files


def test_track_documents(spark, tmp_path):
    body = {
        "player_0": {"trajectory": [[1, 2, 3, 4], None, [True, 1, 1, 1], ["5", 1, 1, 1], [1, 2, 3], 7], "jersey_number": "00"},
        "ball": {"trajectory": []},
        "player_9": {},
    }
    (tmp_path / "clip7.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("[1]")
    read = doc.read_tracks(spark, str(tmp_path))
    tracks = {r.track_id: r for r in read["tracks"].collect()}
    assert tracks["player_0"].n_frames == 6 and tracks["player_0"].jersey_number == "00"
    assert tracks["ball"].n_frames == 0 and tracks["player_9"].n_frames is None
    rows = read["boxes"].orderBy("frame").collect()
    assert [r.x for r in rows] == [1.0, None, None, None, None, None]
    assert rows[0].clip_id == "clip7"
    assert [r.clip_id for r in read["bad_files"].collect()] == ["bad"]


def test_reports_and_bad_reports(spark, tmp_path):
    good = {"player_predictions": [{"player_id": "p", "event": "Foul", "class_probabilities": {"Foul": 0.9}}], "temporal_events": []}
    (tmp_path / "w1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "w2.json").write_text('{"player_predictions": "no list"}')
    read = doc.read_reports(spark, str(tmp_path))
    (row,) = read["player_predictions"].collect()
    assert (row.window_id, row.pos, row.class_probabilities) == ("w1", 0, {"Foul": 0.9})
    assert [r.window_id for r in read["bad_files"].collect()] == ["w2"]


def test_a_bad_track_costs_only_itself(spark, tmp_path):
    body = {"player_0": {"trajectory": [[1, 2, 3, 4]]}, "player_1": 7, "player_2": None, "player_3": {"trajectory": 5}, "player_4": "{text}"}
    (tmp_path / "clip.json").write_text(json.dumps(body))
    (tmp_path / "cut.json").write_text('{"player_0": {"trajectory": [[1,')
    read = doc.read_tracks(spark, str(tmp_path))
    assert {r.track_id: (r.is_object, r.n_frames) for r in read["tracks"].collect() if r.track_id != "player_4"} == {
        "player_0": (True, 1), "player_1": (False, None), "player_2": (False, None), "player_3": (True, None)
    }
    assert [r.clip_id for r in read["bad_files"].collect()] == ["cut"]


def test_a_mistyped_field_costs_only_itself(spark, tmp_path):
    entries = [{"player_id": "p", "confidence": "high", "label_id": 2}, {"player_id": "q", "confidence": 0.5}, 3]
    (tmp_path / "w.json").write_text(json.dumps({"player_predictions": entries, "duration_seconds": "x"}))
    read = doc.read_reports(spark, str(tmp_path))
    rows = read["player_predictions"].orderBy("pos").collect()
    assert [(r.player_id, r.confidence, r.label_id) for r in rows] == [("p", None, 2), ("q", 0.5, None), (None, None, None)]
    assert read["bad_files"].count() == 0 and read["reports"].first().duration_seconds is None


def test_semicolon_files_are_paired_by_row(spark, tmp_path, frame):
    actions = "[{'player': '00', 'action': 'Foul', 'result': None}]"
    (tmp_path / "a.csv").write_bytes("﻿urls;actions\n".encode() + f"http://x/1;{actions}\nhttp://x/2;[]\nhttp://x/3;[]\n".encode())
    (tmp_path / "b.csv").write_text(f"urls;actions;numerosity\ng-1\\7.mp4;{actions};1\ng-1/8.mp4;[1];0\n")
    source, paths = (tb.read_semicolon_csv(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv"))
    assert source.columns == ["urls", "actions"]
    captions = frame(
        [("g-1/7.mp4", 0, "human", "q"), ("g-1/7.mp4", 1, "gpt", " first "), ("g-1/7.mp4", 2, "assistant", " last ")],
        "video string, turn int, role string, text string",
    )
    loaded = tb.load_metadata(source, paths, captions)
    (record,) = loaded["records"].collect()
    assert (record.video_key, record.game, record.numerosity, record.gt_caption) == ("g-1/7.mp4", "g-1", 1, "last")
    assert [(r.row_index, r.code) for r in loaded["anomalies"].orderBy("row_index").collect()] == [
        (1, "ACTION_MISMATCH"), (2, "ROW_COUNT_MISMATCH")
    ]
    parsed = loaded["records"].select(tb.parse_actions(F.col("actions")).alias("p")).collect()[0].p
    assert parsed.actions[0].player == "00" and parsed.actions[0].result is None


def test_line_breaks_empty_fields_and_bad_numbers(spark, tmp_path, frame):
    (tmp_path / "a.csv").write_text('urls;actions\nu0;"[1,\n2]"\nu1;\nu2;[]\nu3;[]\n')
    (tmp_path / "b.csv").write_text('urls;actions;numerosity\ng/0.mp4;"[1,\n2]";3\ng/1.mp4;"";2\ng/2.mp4;[];many\n')
    source, paths = (tb.read_semicolon_csv(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv"))
    records, anomalies = tb.pair_by_position(source, paths)
    assert [(r.video_key, r.actions, r.numerosity) for r in records.orderBy("row_index").collect()] == [("g/0.mp4", "[1,\n2]", 3), ("g/1.mp4", "", 2)]
    assert [tuple(r) for r in anomalies.orderBy("row_index").collect()] == [(2, "BAD_NUMEROSITY"), (3, "ROW_COUNT_MISMATCH")]


def test_literals_that_are_not_lists_of_objects(frame):
    texts = ["[1]", "{'a': 1}", "open('x')", "[{'player': 7.0, 'result': True, 'assisted': 1}]"]
    rows = frame([(t,) for t in texts], "t string").select(tb.parse_actions(F.col("t")).alias("p")).collect()
    assert [r.p.error is None for r in rows] == [False, False, False, True]
    assert (rows[3].p.actions[0].player, rows[3].p.actions[0].result, rows[3].p.actions[0].assisted) == ("7", True, None)


def test_inventory_and_digests(spark, tmp_path, frame):
    (tmp_path / "a.mp4").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = fl.list_files(spark, str(tmp_path))
    path = f"file:{tmp_path}/a.mp4"
    probes = frame([(path, 4, 3, 25.0, 50)], "path string, width int, height int, fps double, frame_count int")
    good, rejected = fl.file_inventory(files, probes)
    (video,) = good.collect()
    assert (video.filename, video.file_size_bytes, video.duration_seconds, len(video.video_id)) == ("a.mp4", 3, 2.0, 16)
    assert [r.reason for r in rejected.collect()] == ["unsupported_suffix"]
    digests = fl.read_digests(spark, str(tmp_path))
    manifest = digests.unionByName(frame([("gone", "x")], "path string, sha256 string"))
    wrong = manifest.withColumn("sha256", F.when(F.col("path").endswith("b.txt"), "0").otherwise(F.col("sha256")))
    assert {os.path.basename(r.path): r.status for r in fl.digest_verify(wrong, digests).collect()} == {
        "a.mp4": "ok", "b.txt": "mismatch", "gone": "missing"
    }


def test_failed_rows_of_a_hook_stay(frame):
    df = frame([(i,) for i in range(20)], "k int")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["k"] == 7).any():
            raise RuntimeError("no")
        return pd.DataFrame({"k": batch["k"], "score": batch["k"] * 2.0})

    rows = {r.k: r for r in score_with(df, model, "score double", ["k"]).collect()}
    assert len(rows) == 20 and rows[7].error == "RuntimeError: no" and rows[7].score is None
    assert rows[8].score == 16.0 and rows[8].error is None


def test_a_hook_may_return_its_results_alone(frame):
    df = frame([(i,) for i in range(9)], "k int")
    rows = score_with(df, lambda b: pd.DataFrame({"score": b["k"].to_numpy() * 2.0}), "score double", ["k"]).collect()
    assert {r.k: (r.score, r.error) for r in rows} == {k: (2.0 * k, None) for k in range(9)}
    rows = score_with(df, lambda b: pd.DataFrame({"score": [1.0] * 50}), "score double", ["k"]).collect()
    assert len(rows) == 9 and all(r.error == "ValueError: 50 results for 1 rows" for r in rows)


def test_new_files_are_processed_once(spark, tmp_path, frame):
    schema = "video_id string, duration_seconds double, fps double, frame_count bigint"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i, duration in enumerate((30.0, 12.0)):
        frame([(f"v{i}", duration, 25.0, 750)], schema).write.mode("append").parquet(source)
        process_new_files(spark, source, schema, plan_windows, out, mark)
    assert spark.read.parquet(out).count() == 4


def test_jsonl_keeps_nulls(frame, tmp_path):
    sinks.write_jsonl(frame([("a", None)], "game string, x string"), str(tmp_path / "m"))
    line = next((tmp_path / "m").glob("*.json")).read_text().strip()
    assert json.loads(line) == {"game": "a", "x": None}


def one(frame, expression):
    return frame([(1,)], "x int").select(expression.alias("v")).collect()[0].v


def test_text_functions(frame):
    lit = F.lit
    assert one(frame, fn.identifier(lit("  Game 001!! "))) == "game-001"
    assert one(frame, fn.participant_id(lit(" "), lit("White"), lit(None).cast("string"), lit(""))) == "white#unknown"
    assert one(frame, fn.participant_label(lit(""), lit(" 7 "), lit("p"))) == "unknown #7"
    assert one(frame, fn.parse_track_reference(lit("a/b/player_1"))).window_id == "a/b"
    assert one(frame, fn.parse_track_reference(lit("a/ "))) is None
    assert one(frame, fn.game_team_codes(lit("bkn-vs-det-0022400861"))) == ["BRK", "DET"]
    assert one(frame, fn.normalize_video_key(lit(".\\g//x/./1.mp4"))) == "g/x/1.mp4"
    assert one(frame, fn.normalize_confidence(lit("Medium"))) == 0.6
    assert one(frame, fn.normalize_confidence(lit("7"))) == 1.0
    assert one(frame, fn.strict_confidence(lit("7"))) is None
    assert one(frame, fn.query_value(lit("http://x/?a=&b=+&a=c%20d+e#z"), "a")) == "c d e"
    assert one(frame, fn.event_name(lit(" ASSIST "))) == "ast"
    assert [one(frame, fn.normalize_jersey_number(lit(s))) for s in ("0", "00", "123", "١")] == ["0", "00", None, None]


def test_digests_are_read_in_pieces(spark, tmp_path):
    import hashlib

    content = {"a b.bin": bytes(range(256)) * 1000, "c%20d.bin": b"x" * 70_001}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in fl.read_contents(spark, str(tmp_path), "*.bin", 7_000, 50_000).collect()}
    assert {k: v for k, v in got.items()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()}


def test_changed_texts_have_their_own_length(spark, tmp_path):
    texts = [(3, "café"), (13, "a\n"), (23, ""), (33, "x~"), (43, "\U0001f600"), (5, "gone"), (4, "sameé")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = all_queries()
    got = queries["read_digests"](spark, str(tmp_path)).select("doc_id", "length", "status").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.execute(f"SELECT doc_id, length, status FROM ({sql['read_digests']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert dict((r.doc_id, r.length) for r in got)[3] == 5


def test_files_of_a_manifest_are_read_without_a_listing(spark, tmp_path, frame):
    import hashlib

    texts = [("a/1 %20é.txt", "é\n"), ("a/2.txt", ""), ("b/c/3.txt", "x" * 20_000)]
    fl.write_contents(frame(texts, "path string, content string"), str(tmp_path))
    assert [(tmp_path / p).read_bytes() for p, _ in texts] == [t.encode() for _, t in texts]
    rows = [(k, p, hashlib.sha256(t.encode()).hexdigest().upper()) for k, (p, t) in enumerate(texts)]
    manifest = frame([*rows, (7, "a/2.txt", "0"), (8, "a/none.txt", "0"), (9, "none/1.txt", "0")], "k int, path string, sha256 string")
    checked = fl.verify_contents(manifest, f"file:{tmp_path}", 7_000)
    assert checked.columns == ["k", "path", "sha256", "length", "status"]
    got = {r.k: (r.length, r.status) for r in checked.collect()}
    assert got == {0: (3, "ok"), 1: (0, "ok"), 2: (20_000, "ok"), 7: (0, "mismatch"), 8: (None, "missing"), 9: (None, "missing")}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "binaryFile" not in plan
    out = frame([(1, "../x", "0")], "k int, path string, sha256 string")
    with pytest.raises(Exception, match="not below"):
        fl.verify_contents(out, str(tmp_path)).collect()


def test_digests_make_no_folder_per_text_and_tell_repeated_keys_apart(spark, tmp_path):
    texts = [(k % 30, f"text {k}") for k in range(60)] + [(1, "text 1")] * 2
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = all_queries()
    checked = queries["read_digests"](spark, str(tmp_path))
    assert "binaryFile" not in checked._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.execute(f"SELECT doc_id, length, status FROM ({sql['read_digests']})").fetchall()
    assert sorted(map(tuple, checked.collect()), key=str) == sorted(expected, key=str)


def test_a_half_that_must_hold_the_bad_row_is_not_tried(frame):
    calls = []

    def model(batch):
        calls.append(len(batch))
        if (batch["k"] == 63).any():
            raise ValueError("no")
        return pd.DataFrame({"calls": [len(calls)] * len(batch)})

    df = frame([(i,) for i in range(64)], "k int").coalesce(1)
    rows = {r.k: r for r in score_with(df, model, "calls int", ["k"]).collect()}
    assert len(rows) == 64 and rows[63].error == "ValueError: no" and all(rows[k].error is None for k in range(63))
    # the whole batch, then a left half on each of six levels
    assert max(r.calls for k, r in rows.items() if k != 63) == 7


def test_jsonl_folders_hold_few_files(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 20).cast("string").alias("game"), F.col("id").alias("n")).repartition(8)
    path = str(tmp_path / "lines")
    sinks.write_jsonl(rows, path, by="game")
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) == 20
    assert spark.read.json(path).count() == 400


def test_usual_literals_read_the_same_without_the_compiler():
    usual = [
        "[]", "[{}]", "[{'player': '7', 'result': True}, {'player': 0, \"color\": 'a \"b\" {', 'result': None}]",
        "[{'result': 'True', 'assisted': 3, 'other_player': False}]", "[{'player': 1, 'player': '2', 'x': 'é]'}]",
    ]
    for text in usual:
        assert tb._plain_literal(text) == tb._literal(text)
    for text in ("[{'player': 07}]", "[{'player': 'a' 'b'}]", "[{'player': '\\x41'}]", "[{'player': 1.0}]", "[{'player': 1}", "[[]]", ""):
        assert tb._plain_literal(text) is None


def test_parsed_literals_leave_a_batch_as_arrow_columns():
    out = tb._parse_literals.func(pa.array(["[{'player': 3}]", None, "[{'player'", "[]", "[{'player': 1.0, 'result': True}]"]))
    actions, errors = out.field("actions").to_pylist(), out.field("error").to_pylist()
    assert [None if a is None else [(x["player"], x["result"]) for x in a] for a in actions] == [[("3", None)], None, None, [], [("1", True)]]
    assert [e and e.split(":")[0] for e in errors] == [None, "ValueError", "SyntaxError", None, None]


def test_packed_track_documents_read_like_files(spark, tmp_path):
    texts = {
        "a": '{"player_1": {"trajectory": [[1, 2, 3, 4], null, [1, 2]]}, "ball": 7}', "b": "[]", "c": "{}",
        "d": ' {"x": {"trajectory": []}}', "e": '{"x": ', "f": " ",
    }
    for name, text in texts.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{name}.json").write_text(text)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "part.txt").write_text("\n".join(f"{k}\t{v}" for k, v in texts.items()))
    files, packed = doc.read_tracks(spark, str(tmp_path / "files")), doc.read_tracks(spark, str(tmp_path / "packed"), packed=True)
    for table in ("tracks", "boxes", "bad_files"):
        rows = [sorted(map(str, read[table].drop("path").collect())) for read in (files, packed)]
        assert rows[0] == rows[1] and rows[0]
    assert {r.clip_id for r in packed["bad_files"].collect()} == {"b", "e", "f"}


def test_documents_are_parsed_once(spark, tmp_path, frame):
    (tmp_path / "w.json").write_text("{}")
    tracks, reports = doc.read_tracks(spark, str(tmp_path)), doc.read_reports(spark, str(tmp_path))
    for rows in (tracks["boxes"], reports["player_predictions"]):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    texts = frame([("[]",)], "t string")
    failed = texts.select(tb.parse_actions(F.col("t"))["error"].alias("e")).filter("e IS NOT NULL")
    assert failed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_packed_reports_read_like_files(spark, tmp_path):
    texts = {"w1": '{"player_predictions": [{"player_id": "a\\tb"}, 3], "duration_seconds": 2}', "w2": "[]", "w3": '{"temporal_events": 1}'}
    for folder in ("files", "packed"):
        (tmp_path / folder).mkdir()
    for name, text in texts.items():
        (tmp_path / "files" / f"{name}.json").write_text(text)
    (tmp_path / "packed" / "part.txt").write_text("\n".join(f"{k}\t{v}" for k, v in texts.items()))
    files, packed = doc.read_reports(spark, str(tmp_path / "files")), doc.read_reports(spark, str(tmp_path / "packed"), packed=True)
    for table in ("reports", "player_predictions", "temporal_events", "bad_files"):
        rows = [sorted(map(str, read[table].drop("path").collect())) for read in (files, packed)]
        assert rows[0] == rows[1]
    assert {r.window_id for r in packed["bad_files"].collect()} == {"w2", "w3"}
