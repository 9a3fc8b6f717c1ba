import duckdb
import pytest
from pyspark.sql import functions as F

from clipledger.operators import catalog as cat
from clipledger.plans import all_queries
from clipledger.sources import sinks

MAT = "material_id string, source_video_id string, segment_id string, video_path string, start_seconds double, end_seconds double, processing_status string, metadata_json string"
EVT = "material_id string, event_seq bigint, event_name string, confidence double, player_id string, participant_id string, identity_status string, start_seconds double, end_seconds double"
PPL = "material_id string, participant_id string, track_id string, jersey_color string, jersey_number string, player_name string, identity_status string"
PER = "participant_id string, display_name string, jersey_color string, jersey_number string, metadata_json string, created_at string, updated_at string"


@pytest.fixture()
def catalog(frame):
    return cat.Catalog(
        frame([("white-13", "Ann", "white", "13", "{}", "t0", "t0")], PER),
        frame([("m1", "v", "s1", "a", 5.0, 9.0, "ready", "{}"), ("m2", "v", "s2", "b", 1.0, 2.0, "ready", "{}")], MAT),
        frame(
            [("m1", 1, "Made Shot", 0.9, "p", "white-13", "identified", None, None), ("m1", 2, "Foul", 0.8, "q", "black-5", "identified", None, None)], EVT
        ),
        frame([("m2", "white-13", "t", "white", "13", None, None)], PPL),
    )


def ids(df):
    return [r.material_id for r in df.collect()]


def test_person_and_event_must_be_on_one_row(catalog):
    assert ids(cat.find_materials(catalog, "Made Shot", "white-13")) == ["m1"]
    assert ids(cat.find_materials(catalog, "Made Shot", "black-5")) == []


def test_person_search_ignores_confidence_and_reads_both_tables(catalog):
    assert ids(cat.find_materials(catalog, person="white-13", minimum_confidence=0.99)) == ["m2", "m1"]
    assert ids(cat.find_materials(catalog, "Foul", minimum_confidence=0.81)) == []
    assert ids(cat.list_materials(catalog)) == ["m2", "m1"]


def test_nested_material_keeps_order(catalog):
    (row,) = cat.get_material(catalog, "m1").collect()
    assert [e.event_name for e in row.events] == ["Made Shot", "Foul"] and row.participants is None


def test_stored_jersey_is_not_normalised(catalog, frame):
    assert cat.find_participants_by_jersey(catalog.participants, " WHITE ", " 13").count() == 1
    shouting = frame([("x", "X", "WHITE", "13", "{}", "t", "t")], PER)
    assert cat.find_participants_by_jersey(shouting, "WHITE", "13").count() == 0


def test_replace_removes_old_children(catalog, frame, tmp_path, spark):
    new = cat.Catalog(
        catalog.participants,
        frame([("m1", "v", "s1", "c", 0.0, 3.0, "ready", "{}")], MAT),
        frame([("m1", 1, "steal", 0.5, None, None, None, None, None)], EVT),
        frame([], PPL),
    )
    refused = {r.violation for r in cat.material_violations(new.materials, catalog.materials, False).collect()}
    assert refused == {"duplicate_material"}
    assert cat.material_violations(new.materials, catalog.materials, True).count() == 0
    saved = cat.save_materials(catalog, new, replace=True)
    sinks.write_catalog(saved, str(tmp_path / "v2"))
    stored = sinks.read_catalog(spark, str(tmp_path / "v2"))
    assert [r.event_name for r in stored.material_events.filter("material_id = 'm1'").collect()] == ["steal"]
    assert stored.materials.count() == 2
    counts = {r["item"]: r["n"] for r in cat.status(stored).collect()}
    assert counts == {"participants": 1, "materials": 2, "material_events": 1, "material_participants": 1}


def test_integrity_rules(catalog, frame):
    bad = frame([("m3", "v", "s1", "c", 3.0, 1.0, "ready", "{}"), ("m4", "v", "s9", "c", 0.0, 1.0, "ready", "{}")], MAT)
    found = {(r.material_id, r.violation) for r in cat.material_violations(bad, catalog.materials, False).collect()}
    assert found == {("m3", "end_before_start"), ("m3", "duplicate_segment")}


def test_participants_upsert(catalog, frame):
    schema = "participant_id string, pos int, display_name string, jersey_color string, jersey_number string, metadata_json string"
    source = frame([("white-13", 0, "Bo", "white", "13", "{}"), ("white-13", 1, "Cy", "white", "13", "{}"), ("n", 2, "N", None, None, "{}")], schema)
    rows = {r.participant_id: r for r in cat.save_participants(catalog.participants, source, F.lit("t1")).collect()}
    assert (rows["white-13"].display_name, rows["white-13"].created_at, rows["white-13"].updated_at) == ("Cy", "t0", "t1")
    assert rows["n"].created_at == "t1"
    with pytest.raises(Exception, match="participant exists"):
        cat.save_participants(catalog.participants, source, F.lit("t1"), replace=False).collect()


def test_migration_adds_columns_and_refuses_newer(catalog):
    old = catalog.material_events.drop("participant_id", "identity_status")
    assert cat.migrate_events(old, 1).filter("participant_id IS NULL").count() == 2
    with pytest.raises(ValueError):
        cat.migrate_events(old, 3)


def test_report_statistics(frame):
    schema = "material_id string, pos int, player_id string, participant_id string, jersey_color string, jersey_number string, player_name string, identity_status string, event string, confidence double"
    predictions = frame(
        [("m", 0, "player_0", None, "White", "20", None, None, "Made Shot", 0.9), ("m", 1, "player_1", None, None, None, None, None, "blank", 0.8)], schema
    )
    temporal = frame([("m", 0, "player_0", None, None, "Made Shot", 0.9, 1.0, 2.0)], "material_id string, pos int, player_id string, participant_id string, identity_status string, event string, confidence double, start_time double, end_time double")
    (total,) = cat.summarize_reports(frame([("m",)], "m string"), predictions, temporal).collect()
    assert (total.clip_count, total.player_prediction_count, total.non_background_prediction_count, total.temporal_event_count) == (1, 2, 1, 1)
    assert total.mean_confidence == pytest.approx(0.85)
    counts = {(r.kind, r.name): r.n for r in cat.count_reports(predictions).collect()}
    assert counts[("participant", "white #20")] == 1 and counts[("event", "blank")] == 1
    tags = cat.events_with_fallback(predictions, temporal).collect()
    assert [t.event_name for t in tags] == ["Made Shot"]
    none = cat.events_with_fallback(predictions, temporal.filter("false")).collect()
    assert [(t.event_name, t.start_seconds) for t in none] == [("Made Shot", None)]


def test_final_material_needs_length(frame):
    drafts = frame([("m", "v", "p", 2.0, 2.0)], "material_id string, source_video_id string, video_path string, start_seconds double, end_seconds double")
    events = frame([], "material_id string, event_seq int, event string, confidence double, global_track_id string, participant_id string, identity_status string, evidence_start_seconds double, evidence_end_seconds double")
    people = frame([], PPL)
    with pytest.raises(Exception, match="material without length"):
        cat.build_final_materials(drafts, events, people)[0].collect()
    good, tags, _ = cat.build_final_materials(drafts.withColumn("end_seconds", F.lit(3.0)), events, people)
    assert good.collect()[0].processing_status == "ready_without_event" and tags.count() == 0


def test_registered_materials_carry_metadata_and_persons(frame, catalog):
    exported = frame(
        [("v", "m7", ["e1", "e2"], "a.mp4", 0.0, 5.0), ("v", "m8", ["gone"], "b.mp4", 5.0, 6.0)],
        "source_video_id string, material_id string, event_ids array<string>, video_path string, start_seconds double, end_seconds double",
    )
    events = frame(
        [("e1", "v", "Foul", 0.5, None, 0.0, 1.0), ("e2", "v", "blank", 0.5, None, 1.0, 2.0)],
        "event_id string, source_video_id string, event string, confidence double, global_track_id string, evidence_start_seconds double, evidence_end_seconds double",
    )
    identities = frame(
        [("e1", "white-13", "identified", "white", "13", "Bea", ["w/p1"], None), ("e2", None, "unresolved", None, None, None, None, "t")],
        "event_id string, participant_id string, status string, jersey_color string, jersey_number string, player_name string, track_references array<string>, track_id string",
    )
    none = frame([], "source_video_id string, material_id string, participant_id string, track_id string, jersey_color string, jersey_number string, player_name string, identity_status string")
    saved = cat.register_final(catalog, exported, events, identities, none, F.lit("t1"))
    rows = {r.material_id: r for r in saved.materials.collect()}
    assert (rows["m7"].processing_status, rows["m8"].processing_status) == ("ready", "ready_without_event")
    assert rows["m7"].metadata_json == '{"event_ids":["e1","e2"],"boundary_source":"event_timeline","identity_available":true}'
    assert rows["m8"].metadata_json.endswith('"identity_available":false}')
    (person,) = saved.participants.collect()
    assert (person.display_name, person.created_at, person.updated_at, person.metadata_json) == ("Bea", "t0", "t1", '{"identity_status":"identified"}')
    after = cat.save_materials(catalog, saved)
    assert cat.find_materials(after, "Foul", "white-13").first().material_id == "m7"


def test_final_materials_meet_their_events_once(frame):
    drafts = frame([("v1", "m7", ["e1"], "a.mp4", 0.0, 2.0), ("v2", "m8", ["e2"], "a.mp4", 0.0, 2.0)], "source_video_id string, material_id string, event_ids array<string>, video_path string, start_seconds double, end_seconds double")
    events = frame([("e1", "v1", "blank", 0.5, None, 0.0, 1.0), ("e2", "v2", "Foul", 0.5, None, 0.0, 1.0)], "event_id string, source_video_id string, event string, confidence double, global_track_id string, evidence_start_seconds double, evidence_end_seconds double")
    identities = frame([("e1", "p1", "identified", None, None, None, None, "t")], "event_id string, participant_id string, status string, jersey_color string, jersey_number string, player_name string, track_references array<string>, track_id string")
    old = frame([(v, m, "old", "t", None, None, None, None) for v, m in (("v1", "m7"), ("v2", "m8"))], "source_video_id string, material_id string, participant_id string, track_id string, jersey_color string, jersey_number string, player_name string, identity_status string")
    people = frame([], "participant_id string, display_name string, jersey_color string, jersey_number string, metadata_json string, created_at string, updated_at string")
    catalog = cat.Catalog(people, None, None, None)
    materials = cat.register_final(catalog, drafts, events, identities, old, F.lit("t1")).materials
    rows = {r.material_id: (r.processing_status, r.metadata_json[-26:]) for r in materials.collect()}
    assert rows == {"m7": ("ready_without_event", '"identity_available":true}'), "m8": ("ready", '"identity_available":true}')}
    assert materials._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6


def test_events_of_large_order_keys_stay_apart(spark, tmp_path):
    lines = spark.sql(
        "SELECT * FROM VALUES (100000L, 1L, 1, 0.05D), (0L, 2L, 1, 0.05D), (10L, 3L, 2, 0D) AS t(l_orderkey, l_partkey, l_linenumber, l_tax)"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    queries, sql = all_queries()
    events = queries["finalize_events"](spark, str(tmp_path)).select("event_id", "material_id", "participant_id").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = db.execute(f"SELECT event_id, material_id, participant_id FROM ({sql['finalize_events']})").fetchall()
    assert sorted(map(tuple, events), key=str) == sorted(expected, key=str)
    assert sorted(r.material_id for r in events) == ["m0", "m10", "m100000"]
