import glob
import os
import uuid

import pytest

from clipledger.operators import catalog as cat
from clipledger.sources import catalog_store as store
from test_catalog import EVT, MAT, PER, PPL

NAMES = ["Foul", "Rebound", "ast", "Made Shot", "block", "steal", "Turnover", "Free Throw"]


def big_catalog(frame, n=400):
    materials = [(f"m{k}", f"v{k % 7}", f"s{k}", "a", float(k), k + 1.0, "ready", "{}") for k in range(n)]
    events = [(f"m{k}", j, NAMES[(k + j) % 8], 0.1 * (k % 10), "p", f"p{(k * 3 + j) % 50}", "identified", None, None) for k in range(n) for j in range(3)]
    people = [(f"m{k}", f"p{k % 50}", "t", "white", "13", None, None) for k in range(n)]
    return cat.Catalog(frame([("p1", "Ann", "white", "13", "{}", "t", "t")], PER), frame(materials, MAT), frame(events, EVT), frame(people, PPL))


def executed(df):
    """(plan's text, files read per scan) of a frame that has run."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    leaves = run.executedPlan().collectLeaves()
    files = [leaves.apply(k).metrics().get("numFiles") for k in range(leaves.size())]
    return run.executedPlan().toString(), [x.get().value() for x in files if x.isDefined()]


@pytest.fixture()
def plain_plans(spark):
    """Plans as for large tables: no broadcast, nothing decided while running."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_published_search_needs_no_exchange_and_few_files(spark, frame, tmp_path, plain_plans):
    catalog, name = big_catalog(frame), "t" + uuid.uuid4().hex
    stored = store.publish_catalog(catalog, str(tmp_path), name, 4)
    for args in ({"event": "Foul", "person": "p0"}, {"event": "ast", "minimum_confidence": 0.5}, {"person": "p0"}):
        want = {r.material_id for r in cat.find_materials(catalog, **args).collect()}
        found = cat.find_materials(stored, **args, ordered=False)
        assert {r.material_id for r in found.collect()} == want and want
        if "event" in args:
            plan, files = executed(found)
            assert "Exchange" not in plan
            assert sorted(files) == [4, 4]  # a file per bucket of the materials and of one event's folder, of eight
    written = glob.glob(f"{tmp_path}/material_events/*/*.parquet")
    assert len(written) == 4 * 8


def test_published_catalog_is_opened_in_another_session(spark, frame, tmp_path, plain_plans):
    catalog = big_catalog(frame, 100)
    store.publish_catalog(catalog, str(tmp_path), "first" + uuid.uuid4().hex, 4)
    other = store.open_catalog(spark.newSession(), str(tmp_path), "again" + uuid.uuid4().hex, 4)
    want = {r.material_id for r in cat.find_materials(catalog, "Foul", "p0").collect()}
    found = cat.find_materials(other, "Foul", "p0", ordered=False)
    assert {r.material_id for r in found.collect()} == want
    assert other.material_events.count() == 300


def test_events_without_a_name_are_refused(frame, tmp_path):
    catalog = big_catalog(frame, 3)
    nameless = cat.Catalog(catalog.participants, catalog.materials, frame([("m1", 1, None, 0.5, "p", "p1", "x", None, None)], EVT), catalog.material_participants)
    with pytest.raises(Exception, match="event_name is missing"):
        store.publish_catalog(nameless, str(tmp_path), "t" + uuid.uuid4().hex, 2)


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/__part=*/*.parquet")}


def test_saving_ten_materials_leaves_other_folders(spark, frame, tmp_path):
    catalog, path = big_catalog(frame), str(tmp_path / "kept")
    store.write_keyed_catalog(catalog, path, 64)
    before = stamps(path)
    ids = [f"m{k}" for k in range(5)] + [f"new{k}" for k in range(5)]
    source = cat.Catalog(
        catalog.participants,
        frame([(x, "v", f"z{x}", "b", 0.0, 1.0, "ready", "{}") for x in ids], MAT),
        frame([(x, 1, "steal", 0.5, "p", "p1", "identified", None, None) for x in ids], EVT),
        frame([], PPL),
    )
    changed = store.save_keyed(path, source, 64)
    after = stamps(path)
    assert 0 < changed <= 30
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) >= len(before) - changed
    kept = store.read_keyed_catalog(spark, path, catalog)
    want = cat.save_materials(catalog, source, replace=True)
    for table in ("materials", "material_events", "material_participants"):
        columns = getattr(want, table).columns
        assert sorted(map(str, getattr(kept, table).select(*columns).collect())) == sorted(map(str, getattr(want, table).collect()))
    assert store.save_keyed(path, source, 64) == 0
    assert stamps(path) == after


def test_a_folder_that_loses_all_rows_goes(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    rows = frame([("a", 1), ("b", 2)], "material_id string, n int")
    store.write_keyed(rows, path, 1000)
    assert store.replace_keyed(path, rows.filter("n = 1"), rows.limit(0), 1000) == 1
    assert [r.material_id for r in store.read_keyed(spark, path).collect()] == ["b"]
    assert store.replace_keyed(path, rows.filter("n = 1"), rows.limit(0), 1000) == 0


def test_a_save_sets_only_its_keys_aside(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_keyed(frame([(f"m{k % 9}", k) for k in range(30)] + [(None, 99)], "material_id string, n int"), path, 4)
    aside, cut = [], store.cut_lineage
    monkeypatch.setattr(store, "cut_lineage", lambda df: aside.append(df.columns) or cut(df))
    keys = frame([("m1",), ("m2",), ("x",)], "material_id string")
    fresh = frame([("m1", -1), ("m1", -1), ("x", -2)], "material_id string, n int")
    assert store.replace_keyed(path, keys, fresh, 4) > 0
    assert store.replace_keyed(path, keys, fresh, 4) == 0
    assert aside == [["material_id", "__part"]] * 2
    kept = sorted((r.material_id or "", r.n) for r in store.read_keyed(spark, path).collect())
    assert kept == sorted([("", 99), ("m1", -1), ("m1", -1), ("x", -2)] + [(f"m{k % 9}", k) for k in range(30) if k % 9 not in (1, 2)])
