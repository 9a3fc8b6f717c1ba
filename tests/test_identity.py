import json

import pyarrow as pa
from pyspark.sql import functions as F

from clipledger.operators import identity as idn
from clipledger.operators import observations as obs
from clipledger.plans.identity import roster_lookup_query
from clipledger.plans.views import Views

OBS = (
    "track_ref string, pos int, frame_index int, is_on_court_player boolean, "
    "jersey_color string, jersey_number string, confidence double"
)
TRACKS = "track_ref string, game string, clip_id string, track_id string"


def test_one_identity_is_named_from_the_roster(frame):
    observations = frame(
        [("t", 0, 5, True, "black", "17", 0.9), ("t", 1, 9, True, "black", "17", 0.8), ("t", 2, 11, False, "white", "3", 1.0)],
        OBS,
    )
    tracks = frame([("t", "Game 001", "100", "player_8")], TRACKS)
    roster = frame([("Game 001", "a", " Black", "17", "Ann")], "game string, team string, color string, jersey string, name string")
    (row,) = idn.resolve_identity(tracks, observations, roster).collect()
    assert (row.status, row.participant_id, row.player_name) == ("identified", "game-001:jersey:black:17", "Ann")
    (candidate,) = idn.identity_candidates(observations).collect()
    assert (candidate.support_count, candidate.frames) == (2, [5, 9])


def test_two_identities_conflict_and_none_is_anonymous(frame):
    observations = frame(
        [("t", 0, 1, True, "white", "20", 0.9), ("t", 1, 2, True, "white", "13", 0.9), ("u", 0, 1, True, "red", None, 0.9)], OBS
    )
    tracks = frame([("t", "game-001", "100", "player_8"), ("u", "g", "1", "p"), ("w", "g", "1", "q")], TRACKS)
    rows = {r.track_ref: r for r in idn.resolve_identity(tracks, observations).collect()}
    assert rows["t"].status == "conflicting"
    assert rows["t"].participant_id == "game-001:clip:100:track:player_8"
    assert rows["t"].jersey_color == "white" and rows["t"].jersey_number is None
    assert (rows["u"].status, rows["u"].jersey_color) == ("anonymous", "red")
    assert (rows["w"].status, rows["w"].observation_count) == ("anonymous", 0)


def test_repeated_roster_name_is_not_unique(frame):
    schema = "game string, color string, jersey string, name string"
    roster = frame([("g", "red", "1", "Ann"), ("g", "red", "1", "Ann"), ("g", "red", "01", "Bo")], schema)
    names = {(r.jersey_number): r.player_name for r in idn.roster_names(roster).collect()}
    assert names == {"1": None, "01": "Bo"}
    asked = frame([("g", " RED", "1"), ("g", "red", "9"), ("g", None, "1"), ("g", "red", "x")], "game string, jersey_color string, jersey_number string")
    got = sorted(r.lookup_status for r in idn.roster_lookup(asked, roster).collect())
    assert got == ["invalid_identity", "invalid_identity", "matched", "no_match"]


def test_identity_switch_stays_visible(frame):
    schema = "track_ref string, frame_index int, pos int, status string, jersey_color string, jersey_number string, number_confidence double"
    observations = frame(
        [("t", 400, 1, "valid", "white", "20", 0.9), ("t", 100, 0, "valid", "white", "13", 0.95),
         ("s", 10, 0, "valid", "white", "20", 0.9), ("s", 20, 1, "valid", "white", "20", 0.8), ("s", 30, 2, "valid", "red", "1", 0.5),
         ("m", 1, 0, "model_output_inconsistency", None, None, None)],
        schema,
    )
    tracks = frame([("t",), ("s",), ("m",), ("z",)], "track_ref string")
    status, candidates, segments = idn.aggregate_observations(observations, tracks, bucket_frames=64)
    assert {r.track_ref: r.status for r in status.collect()} == {
        "t": "mixed_identity", "s": "stable_identity", "m": "model_output_inconsistency", "z": "unresolved"
    }
    ordered = candidates.filter("track_ref = 't'").orderBy(F.desc("confidence_sum"), "jersey_number").collect()
    assert [r.jersey_number for r in ordered] == ["13", "20"]
    runs = segments.filter("track_ref = 't'").orderBy("start_frame").collect()
    assert [(r.jersey_number, r.start_frame, r.end_frame) for r in runs] == [("13", 100, 100), ("20", 400, 400)]
    (run,) = segments.filter("track_ref = 's'").collect()
    assert run.observation_frames == [10, 20]


def test_events_share_evidence_and_person(frame):
    events = frame(
        [("e1", "Foul", "v", ["w0/player_1"]), ("e2", "Foul", "v", ["w0/player_1", "w1/player_2"])],
        "event_id string, event string, source_video_id string, track_references array<string>",
    )
    references = idn.distinct_references(idn.event_references(events))
    assert references.count() == 2
    status = frame([("w0/player_1", "completed"), ("w1/player_2", "failed")], "track_ref string, status string")
    observations = frame([("w0/player_1", 0, 3, True, "white", "13", 0.9)], OBS)
    rows = {r.event_id: r for r in idn.event_actor_identity(events, status, observations).collect()}
    assert rows["e1"].participant_id == rows["e2"].participant_id == "v:jersey:white:13"
    assert rows["e2"].failed_track_references == ["w1/player_2"]
    (report,) = idn.identity_report(idn.event_actor_identity(events, status, observations), status).collect()
    assert (report.event_count, report.unique_track_reference_count, report.failed_track_reference_count) == (2, 2, 1)


def test_only_identified_people_are_shared(frame):
    schema = (
        "source_video_id string, material_id string, pos int, track_id string, status string, jersey_color string, "
        "jersey_number string, participant_id string, player_name string"
    )
    rows = []
    for m in ("m1", "m2"):
        rows.append(("v", m, 0, "player_1", "identified", "White ", "13", None, None))
        rows.append(("v", m, 1, "player_2", "anonymous", None, None, None, None))
    references, profiles = idn.associate_across_materials(frame(rows, schema))
    got = {r.participant_id: r.appearance_count for r in profiles.collect()}
    assert got == {"v:jersey:white:13": 2, "v:material:m1:track:player_2": 1, "v:material:m2:track:player_2": 1}
    assert references.count() == 4


def crops(frame):
    return frame([("t", 1, 10), ("t", 2, 20)], "track_ref string, image_index int, frame_index int")


def parse(frame, text):
    observed, failed = obs.parse_observations(frame([("t", text)], "track_ref string, output_text string"), crops(frame))
    return observed.orderBy("pos").collect(), failed.collect()


def item(index, number, confidence=0.9):
    return {"image_index": index, "is_on_court_player": True, "jersey_color": " White", "jersey_number": number, "confidence": confidence}


def test_model_text_shapes(frame):
    one, two = json.dumps(item(1, "13")), json.dumps(item(2, "13"))
    shapes = {
        f"```json\n{one}\n```\n```json\n{two}\n```": [13, 13],
        f"[{one}, {json.dumps(item(2, None))}]": [13, None],
        f'{{"observations": [{one}]}} {{"observations": [{two}]}}': [13, 13],
        f'{{"observations": [{one}]}} {two}': [13],
        f"text {{broken {one} and {one} {json.dumps(item(7, '5'))}": [13],
        '{"note": 1}': [None],
        '{"observations": []}': [],
    }
    for text, numbers in shapes.items():
        rows, failed = parse(frame, text)
        assert [r.jersey_number and int(r.jersey_number) for r in rows] == numbers, text
        assert not failed
    rows, failed = parse(frame, "sorry")
    assert not rows and failed[0].error


def test_odd_field_values(frame):
    raw = {"is_on_court_player": "yes", "jersey_color": "", "jersey_number": 7, "confidence": "HIGH", "evidence": 0}
    (row,), _ = parse(frame, json.dumps(raw))
    assert (row.image_index, row.frame_index, row.is_on_court_player) == (1, 10, None)
    assert (row.jersey_color, row.jersey_number, row.confidence, row.evidence) == (None, "7", 0.9, None)


def test_json_responses(frame):
    texts = ['```json\n{"a": "20"}\n```', 'well {"a": 1} ok', "[1, 2]", "{nope}", "nope"]
    df = frame([(t,) for t in texts], "t string").select(obs.parse_json_response(F.col("t")).alias("p"))
    got = [(r.p.document is not None, r.p.error) for r in df.collect()]
    assert [g[0] for g in got] == [True, True, False, False, False]
    assert got[0][1] is None and got[3][1] == "not_json"


def test_validation_contradictions_and_stage(frame):
    responses = frame(
        [(None, True, False, "white", "20", 0.9), (None, True, True, "white", "20", 0.9), ("bad", None, None, None, None, None)],
        "parse_error string, is_on_court_player boolean, number_readable boolean, jersey_color_candidate string, "
        "jersey_number_candidate string, number_confidence double",
    )
    rows = obs.validate_observation(responses, ["white"]).collect()
    assert [r.status for r in rows] == ["model_output_inconsistency", "valid", "json_parse"]
    assert rows[0].jersey_number == "20" and len(rows[0].issues) == 2
    notes = frame(
        [(1, 1, None, False, "white jersey with number 13."), (1, 2, "5", False, "")],
        "response_id int, image_index int, jersey_number string, number_readable boolean, note string",
    )
    found = sorted(r.contradiction for r in obs.output_contradictions(notes).collect())
    assert found == [
        "image=1 number_only_in_note=13",
        "image=2 number_despite_unreadable=5",
    ]
    stages = frame(
        [(None, 0, True, "white", None, "no_match"), (None, 0, True, "white", "20", "matched"), (None, 1, True, None, None, None)],
        "parse_error string, contradiction_count int, is_on_court_player boolean, jersey_color string, jersey_number string, lookup_status string",
    )
    assert [r.stage for r in obs.failure_stage(stages).collect()] == ["jersey_number", "complete", "model_output_inconsistency"]


def test_rows_of_one_identity_stay_together(spark):
    identities = spark.sql("SELECT 'g' AS game, 'white' AS jersey_color, cast(id % 3 AS string) AS jersey_number, id FROM range(9)")
    roster = spark.sql("SELECT 'g' AS game, 'white' AS color, cast(id % 2 AS string) AS jersey, 'n' || id AS name FROM range(4)")
    found = idn.roster_lookup(identities, roster)
    ids = {}
    for r in found.collect():
        ids.setdefault((r.jersey_number, r.lookup_status, tuple(r.candidate_names)), set()).add(r.id)
    assert ids == {("0", "ambiguous", ("n0", "n2")): {0, 3, 6}, ("1", "ambiguous", ("n1", "n3")): {1, 4, 7}, ("2", "no_match", ()): {2, 5, 8}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_names_are_joined_to_text_below_the_join_and_rows_are_not_sorted(spark):
    lines = """SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, cast(id % 7 AS int) AS l_linenumber, 1D * (id % 9) AS l_quantity,
        0.01D * (id % 9) AS l_tax, element_at(array('A', 'N', 'R'), cast(id % 3 + 1 AS int)) AS l_returnflag FROM range(900)"""

    class Small(Views):
        def table(self, name):
            return spark.sql(lines if name == "lineitem" else "SELECT id AS s_suppkey, 's' || id AS s_name FROM range(100)")

    views = Small(spark, "")
    rows = roster_lookup_query(views)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join")
    physical = rows._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in physical and "Sort [" not in physical
    got = rows.groupBy("lookup_status").count().collect()
    assert {r.lookup_status for r in got} == {"invalid_identity", "ambiguous", "matched", "no_match"} and sum(r["count"] for r in got) == 900


def test_observations_leave_a_batch_as_arrow_columns():
    out = obs._scan.func(pa.array(['[{"image_index": 1, "confidence": 2}, {"image_index": "x", "jersey_number": 1}]', None, "{}", '{"jersey_number": "7"}']))
    items = [[(i["pos"], i["image_index"], i["use_first"], i["jersey_number"], i["confidence"]) for i in x] for x in out.field("items").to_pylist()]
    assert items[0] == [(0, 1, False, None, 1.0)] and items[1] == [] and items[3] == [(0, None, True, "7", 0.0)]
    assert out.field("error").to_pylist()[:2] == [None, "no_object"]
    assert len(obs._scan.func(pa.array([], pa.string()))) == 0
