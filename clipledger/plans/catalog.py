"""Queries on the material catalog."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.operators import catalog as cat
from clipledger.plans.registry import query
from clipledger.plans.views import Views, text
from clipledger.session import shared_folder
from clipledger.sources.catalog_store import publish_catalog, read_keyed_catalog, save_keyed, write_keyed_catalog

_M = "material_id, source_video_id, segment_id, video_path, start_seconds, end_seconds"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_M.split(", "))


@query(
    "find_event",
    f"""SELECT {_M} FROM materials m WHERE EXISTS (SELECT 1 FROM material_events e WHERE e.material_id = m.material_id
      AND event_name = 'Made Shot' AND confidence >= 0.8)""",
)
def find_event_query(v: Views) -> DataFrame:
    return _shown(cat.find_materials(v.catalog, event="Made Shot", minimum_confidence=0.8))


@query(
    "find_person",
    f"""SELECT {_M} FROM materials m WHERE EXISTS (SELECT 1 FROM material_events e WHERE e.material_id = m.material_id AND participant_id = 'p7')
      OR EXISTS (SELECT 1 FROM material_participants p WHERE p.material_id = m.material_id AND participant_id = 'p7')""",
)
def find_person_query(v: Views) -> DataFrame:
    return _shown(cat.find_materials(v.catalog, person="p7", minimum_confidence=0.9))


@query(
    "find_both",
    f"""SELECT {_M} FROM materials m WHERE EXISTS (SELECT 1 FROM material_events e WHERE e.material_id = m.material_id
      AND event_name = 'Foul' AND confidence >= 0.3 AND participant_id = 'p7')""",
)
def find_both_query(v: Views) -> DataFrame:
    return _shown(cat.find_materials(v.catalog, event="Foul", person="p7", minimum_confidence=0.3))


@query(
    "find_both_published",
    f"""SELECT {_M} FROM materials m WHERE EXISTS (SELECT 1 FROM material_events e WHERE e.material_id = m.material_id
      AND event_name = 'Foul' AND confidence >= 0.3 AND participant_id = 'p7')""",
)
def find_both_published_query(v: Views) -> DataFrame:
    """The same search on the published catalog: folders and buckets instead of whole tables."""
    path = shared_folder(v.spark)
    stored = publish_catalog(v.catalog, path, path.rpartition("/")[2].replace("-", "_"))
    return _shown(cat.find_materials(stored, event="Foul", person="p7", minimum_confidence=0.3))


@query("list_materials", f"SELECT {_M} FROM materials")
def list_materials_query(v: Views) -> DataFrame:
    return _shown(cat.list_materials(v.catalog))


_NESTED = """SELECT m.material_id, coalesce(ev, '') AS events, coalesce(pp, '') AS participants FROM materials m
    LEFT JOIN (SELECT material_id, string_agg(event_name || ':' || player_id || ':' || participant_id, ',' ORDER BY event_seq, event_name, player_id) AS ev
      FROM material_events GROUP BY 1) e ON e.material_id = m.material_id
    LEFT JOIN (SELECT material_id, string_agg(participant_id || '/' || track_id, ',' ORDER BY participant_id, track_id) AS pp
      FROM material_participants GROUP BY 1) p ON p.material_id = m.material_id"""


def _flattened(nested: DataFrame) -> DataFrame:
    events = F.transform("events", lambda e: F.concat_ws(":", e["event_name"], e["player_id"], e["participant_id"]))
    people = F.transform("participants", lambda p: F.concat_ws("/", p["participant_id"], p["track_id"]))
    return nested.select(
        "material_id",
        F.coalesce(F.array_join(events, ","), F.lit("")).alias("events"),
        F.coalesce(F.array_join(people, ","), F.lit("")).alias("participants"),
    )


@query("material_nested", _NESTED)
def material_nested_query(v: Views) -> DataFrame:
    return _flattened(cat.nest_materials(v.catalog.materials, v.catalog))


@query("get_material", _NESTED + " WHERE m.material_id = 'm42'")
def get_material_query(v: Views) -> DataFrame:
    return _flattened(cat.get_material(v.catalog, "m42"))


@query("get_participant", "SELECT * FROM participants WHERE participant_id = 'p11'")
def get_participant_query(v: Views) -> DataFrame:
    found = cat.get_participant(v.catalog.participants, "p11")
    return found.select("participant_id", "display_name", "jersey_color", "jersey_number")


@query(
    "participants_by_jersey",
    "SELECT * FROM participants WHERE jersey_color = 'white' AND jersey_number = '15'",
)
def participants_by_jersey_query(v: Views) -> DataFrame:
    found = cat.find_participants_by_jersey(v.catalog.participants, " White ", "15 ")
    return found.select("participant_id", "display_name", "jersey_color", "jersey_number")


@query(
    "catalog_status",
    """SELECT 'participants' AS item, count(*) AS n FROM participants UNION ALL SELECT 'materials', count(*) FROM materials
    UNION ALL SELECT 'material_events', count(*) FROM material_events UNION ALL SELECT 'material_participants', count(*) FROM material_participants
    UNION ALL SELECT 'schema_version', max(n_regionkey % 3) FROM nation""",
)
def catalog_status_query(v: Views) -> DataFrame:
    versions = v.table("nation").select((F.col("n_regionkey") % 3).alias("version"))
    return cat.status(v.catalog, versions)


def _incoming(v: Views) -> cat.Catalog:
    """New versions of the urgent orders' materials, and some new materials."""
    urgent = v.table("orders").filter("o_orderpriority = '1-URGENT'")
    materials = urgent.select(
        F.when(F.col("o_orderstatus") == "P", text("new", F.col("o_orderkey"))).otherwise(text("m", F.col("o_orderkey"))).alias("material_id"),
        text("v", F.expr("o_custkey div 10")).alias("source_video_id"),
        F.when(F.col("o_orderstatus") == "P", text("n", F.col("o_orderkey"))).otherwise(text("s", F.col("o_orderkey"))).alias("segment_id"),
        F.lit("media/new.mp4").alias("video_path"),
        F.lit(1.0).alias("start_seconds"),
        F.when(F.col("o_totalprice") < 3000, 0.5).otherwise(2.0).alias("end_seconds"),
        F.lit("ready").alias("processing_status"),
        F.lit("{}").alias("metadata_json"),
    )
    events = materials.select(
        "material_id",
        F.lit(1).cast("bigint").alias("event_seq"),
        F.lit("steal").alias("event_name"),
        F.lit(0.5).alias("confidence"),
        F.lit("player_1").alias("player_id"),
        F.lit("p1").alias("participant_id"),
        F.lit("identified").alias("identity_status"),
        F.lit(0.0).alias("start_seconds"),
        F.lit(1.0).alias("end_seconds"),
    )
    people = events.select(
        "material_id", "participant_id", F.col("player_id").alias("track_id"),
        F.lit("white").alias("jersey_color"), F.lit(None).cast("string").alias("jersey_number"),
        F.lit(None).cast("string").alias("player_name"), "identity_status",
    )
    return cat.Catalog(v.catalog.participants, materials, events, people)


_INCOMING = """inc AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'm' END || o_orderkey AS material_id, 'v' || (o_custkey // 10) AS source_video_id,
      CASE WHEN o_orderstatus = 'P' THEN 'n' ELSE 's' END || o_orderkey AS segment_id, o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query(
    "upsert_materials",
    f"""WITH {_INCOMING} SELECT {_M} FROM materials WHERE material_id NOT IN (SELECT material_id FROM inc)
    UNION ALL SELECT material_id, source_video_id, segment_id, 'media/new.mp4', CAST(1 AS DOUBLE), CASE WHEN o_totalprice < 3000 THEN CAST(0.5 AS DOUBLE) ELSE 2 END FROM inc""",
)
def upsert_materials_query(v: Views) -> DataFrame:
    return _shown(cat.save_materials(v.catalog, _incoming(v), replace=True).materials)


@query(
    "upsert_kept",
    f"""WITH {_INCOMING} SELECT {_M}, (SELECT count(*) FROM material_events e WHERE e.material_id = m.material_id) AS n_events FROM materials m WHERE material_id NOT IN (SELECT material_id FROM inc)
    UNION ALL SELECT material_id, source_video_id, segment_id, 'media/new.mp4', CAST(1 AS DOUBLE), CASE WHEN o_totalprice < 3000 THEN CAST(0.5 AS DOUBLE) ELSE 2 END, 1 FROM inc""",
)
def upsert_kept_query(v: Views) -> DataFrame:
    """The upsert on tables kept by key, saved twice: the second time changes no folder."""
    path = shared_folder(v.spark)
    write_keyed_catalog(v.catalog, path)
    incoming = _incoming(v)
    for _ in range(2):
        save_keyed(path, incoming)
    kept = read_keyed_catalog(v.spark, path, v.catalog)
    counts = kept.material_events.groupBy("material_id").agg(F.count(F.lit(1)).alias("n_events"))
    return _shown(kept.materials).join(counts, "material_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query(
    "upsert_material_events",
    f"""WITH {_INCOMING} SELECT material_id, event_name, count(*) AS n FROM (SELECT material_id, event_name FROM material_events
      WHERE material_id NOT IN (SELECT material_id FROM inc) UNION ALL SELECT material_id, 'steal' FROM inc) GROUP BY 1, 2""",
)
def upsert_events_query(v: Views) -> DataFrame:
    saved = cat.save_materials(v.catalog, _incoming(v), replace=True)
    return saved.material_events.groupBy("material_id", "event_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "material_violations",
    f"""WITH {_INCOMING} SELECT material_id, 'end_before_start' AS violation FROM inc WHERE o_totalprice < 3000
    UNION ALL SELECT material_id, 'duplicate_material' FROM inc WHERE o_orderstatus <> 'P'""",
)
def material_violations_query(v: Views) -> DataFrame:
    return cat.material_violations(_incoming(v).materials, v.catalog.materials, replace=False)


@query(
    "save_participants",
    """WITH s AS (SELECT 'p' || l_suppkey AS participant_id, arg_max('name ' || l_orderkey, l_orderkey*1000000 + l_partkey*10 + l_linenumber) AS display_name,
        arg_max(CASE l_returnflag WHEN 'A' THEN 'white' WHEN 'N' THEN 'black' ELSE 'red' END, l_orderkey*1000000 + l_partkey*10 + l_linenumber) AS jersey_color
      FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40 GROUP BY 1)
    SELECT p.participant_id, coalesce(s.display_name, p.display_name) AS display_name, coalesce(s.jersey_color, p.jersey_color) AS jersey_color,
      '2024-01-01 00:00:00' AS created_at, CASE WHEN s.participant_id IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-06-01 00:00:00' END AS updated_at
    FROM participants p LEFT JOIN s ON s.participant_id = p.participant_id""",
)
def save_participants_query(v: Views) -> DataFrame:
    flag = F.col("l_returnflag")
    source = v.table("lineitem").filter("l_linenumber = 1 AND l_quantity > 40").select(
        text("p", F.col("l_suppkey")).alias("participant_id"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        text("name ", F.col("l_orderkey")).alias("display_name"),
        F.when(flag == "A", "white").when(flag == "N", "black").otherwise("red").alias("jersey_color"),
        F.lit("9").alias("jersey_number"),
        F.lit("{}").alias("metadata_json"),
    )
    saved = cat.save_participants(v.catalog.participants, source, F.lit("2024-06-01 00:00:00"))
    return saved.select("participant_id", "display_name", "jersey_color", "created_at", "updated_at")


@query(
    "migrate_events",
    "SELECT material_id, event_seq, CAST(NULL AS VARCHAR) AS participant_id, CAST(NULL AS VARCHAR) AS identity_status FROM material_events",
)
def migrate_events_query(v: Views) -> DataFrame:
    old = v.catalog.material_events.drop("participant_id", "identity_status")
    return cat.migrate_events(old, 1).select("material_id", "event_seq", "participant_id", "identity_status")


_LABEL = """coalesce(lower(coalesce(nullif(jersey_color, ''), 'unknown')) || ' #' || jersey_number, player_id)"""


@query(
    "summarize_reports",
    """SELECT (SELECT count(*) FROM orders) AS clip_count, count(*) AS player_prediction_count,
      count(*) FILTER (WHERE event IS NULL OR event <> 'blank') AS non_background_prediction_count,
      round(avg(confidence), 6) AS mean_confidence, (SELECT count(*) FROM temporal) AS temporal_event_count FROM predictions""",
)
def summarize_query(v: Views) -> DataFrame:
    total = cat.summarize_reports(v.table("orders"), v.predictions, v.temporal)
    return total.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "count_reports",
    f"""SELECT 'event' AS kind, coalesce(event, 'unknown') AS name, count(*) AS n FROM predictions GROUP BY 2
    UNION ALL SELECT 'participant', {_LABEL}, count(*) FROM predictions GROUP BY 2""",
)
def count_reports_query(v: Views) -> DataFrame:
    return cat.count_reports(v.predictions)


_FALLBACK = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY material_id, player_id ORDER BY pos DESC) AS r FROM predictions),
    tags AS (SELECT t.material_id, t.pos AS event_seq, t.event AS event_name, t.confidence, t.player_id, p.participant_id, p.identity_status,
        t.start_time AS start_seconds, t.end_time AS end_seconds
      FROM temporal t LEFT JOIN p ON p.material_id = t.material_id AND p.player_id = t.player_id AND r = 1 WHERE t.event <> 'blank'),
    allt AS (SELECT * FROM tags UNION ALL SELECT material_id, pos, event, coalesce(confidence, 0), player_id, participant_id, identity_status, NULL, NULL
      FROM predictions WHERE event <> 'blank' AND material_id NOT IN (SELECT material_id FROM tags))"""


@query("events_with_fallback", _FALLBACK + " SELECT * FROM allt")
def fallback_query(v: Views) -> DataFrame:
    return cat.events_with_fallback(v.predictions, v.temporal)


_PID = """coalesce(participant_id, lower(coalesce(nullif(jersey_color, ''), 'unknown')) || '#' || jersey_number, player_id)"""


def _identities(v: Views) -> DataFrame:
    return v.predictions.filter("identity_status IS NOT NULL").select(
        "material_id", F.col("player_id").alias("track_id"), "pos", F.col("identity_status").alias("status")
    )


@query(
    "window_participants",
    f"""WITH k AS (SELECT *, {_PID} AS pid FROM predictions),
    l AS (SELECT *, row_number() OVER (PARTITION BY material_id, pid ORDER BY pos DESC) AS r FROM k),
    s AS (SELECT material_id, player_id, arg_max(identity_status, pos) AS status FROM predictions WHERE identity_status IS NOT NULL GROUP BY 1, 2)
    SELECT l.material_id, pid AS participant_id, l.player_id AS track_id, jersey_color, jersey_number, CAST(NULL AS VARCHAR) AS player_name, status AS identity_status
    FROM l LEFT JOIN s ON s.material_id = l.material_id AND s.player_id = l.player_id WHERE r = 1""",
)
def window_participants_query(v: Views) -> DataFrame:
    return cat.window_participants(v.predictions, _identities(v))


@query(
    "build_window_materials",
    _FALLBACK + """ SELECT 'v' || (o_orderkey // 100) || ':w' || o_orderkey AS material_id, 'v' || (o_orderkey // 100) AS source_video_id, 'w' || o_orderkey AS segment_id,
      CASE WHEN 'm' || o_orderkey IN (SELECT material_id FROM allt) THEN 'ready' ELSE 'ready_without_event' END AS processing_status FROM orders""",
)
def build_window_materials_query(v: Views) -> DataFrame:
    def renamed(df: DataFrame) -> DataFrame:
        key = F.substring("material_id", 2, 20).cast("bigint")
        return df.withColumn("k", key).withColumn(
            "material_id", text("v", F.expr("k div 100"), ":w", F.col("k"))
        ).drop("k")

    windows = v.table("orders").select(
        text("v", F.expr("o_orderkey div 100")).alias("source_video_id"),
        text("w", F.col("o_orderkey")).alias("segment_id"),
        F.lit("x.mp4").alias("video_path"),
        F.lit(0.0).alias("start_seconds"),
        F.lit(12.0).alias("end_seconds"),
    )
    materials, _, _ = cat.build_window_materials(windows, renamed(v.predictions), renamed(v.temporal))
    return materials.select("material_id", "source_video_id", "segment_id", "processing_status")


def _final_inputs(v: Views, event_id: Column | None = None):
    """Drafts per order, one event per line, identities for videos of even index."""
    line = v.table("lineitem")
    if event_id is None:
        event_id = text("e", F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    video = text("v", F.expr("l_orderkey div 10"))
    events = line.dropDuplicates(["l_partkey", "l_orderkey", "l_linenumber"]).select(
        event_id.alias("event_id"),
        video.alias("source_video_id"),
        F.lit("Foul").alias("event"),
        F.lit(0.5).alias("confidence"),
        F.lit(None).cast("string").alias("global_track_id"),
        F.lit(0.0).alias("evidence_start_seconds"),
        F.lit(1.0).alias("evidence_end_seconds"),
    )
    drafts = line.dropDuplicates(["l_partkey", "l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(event_id)).alias("event_ids")
    ).select(
        video.alias("source_video_id"), text("m", F.col("l_orderkey")).alias("material_id"), "event_ids"
    )
    identities = line.filter("l_tax >= 0.03 AND l_orderkey div 10 % 2 = 0").groupBy(
        event_id.alias("event_id")
    ).agg(
        text("p", F.min("l_linenumber")).alias("participant_id"),
        F.lit("identified").alias("status"),
        F.lit("white").alias("jersey_color"),
        F.min("l_linenumber").cast("string").alias("jersey_number"),
        F.lit(None).cast("string").alias("player_name"),
        F.when(F.min("l_linenumber") <= 3, F.array(text("w/player_", F.min("l_linenumber")))).alias("track_references"),
        F.lit("t").alias("track_id"),
    )
    references = drafts.select(
        "source_video_id", "material_id", F.lit("old").alias("participant_id"), F.lit("player_0").alias("track_id"),
        F.lit(None).cast("string").alias("jersey_color"), F.lit(None).cast("string").alias("jersey_number"),
        F.lit(None).cast("string").alias("player_name"), F.lit("anonymous").alias("identity_status"),
    )
    return drafts, events, identities, references


_FINAL = """WITH e AS (SELECT DISTINCT 'e' || (l_partkey*1000000 + l_orderkey*10 + l_linenumber) AS event_id, 'v' || (l_orderkey // 10) AS source_video_id,
        'm' || l_orderkey AS material_id FROM lineitem),
    i AS (SELECT 'e' || (l_partkey*1000000 + l_orderkey*10 + l_linenumber) AS event_id, min(l_linenumber) AS ln FROM lineitem
      WHERE l_tax >= 0.03 AND (l_orderkey // 10) % 2 = 0 GROUP BY 1),
    j AS (SELECT e.*, ln FROM e LEFT JOIN i USING (event_id))"""


# Ids that stay apart however many orders there are; a sum of keys meets another's from 100,000 orders on.
_EVENT_KEYS = ("l_partkey", "l_orderkey", "l_linenumber")
_FINAL_APART = _FINAL.replace("(l_partkey*1000000 + l_orderkey*10 + l_linenumber)", " || '_' || ".join(_EVENT_KEYS))


@query(
    "finalize_events",
    _FINAL_APART + " SELECT event_id, source_video_id, material_id, 'p' || ln AS participant_id, CASE WHEN ln IS NOT NULL THEN 'identified' END AS identity_status FROM j",
)
def finalize_events_query(v: Views) -> DataFrame:
    apart = F.concat(F.lit("e"), F.concat_ws("_", *[F.col(k).cast("string") for k in _EVENT_KEYS]))
    return cat.finalize(*_final_inputs(v, apart))[0].select(
        "event_id", "source_video_id", "material_id", "participant_id", "identity_status"
    )


@query(
    "finalize_references",
    _FINAL + """ SELECT DISTINCT source_video_id, material_id, 'p' || ln AS participant_id, CASE WHEN ln <= 3 THEN 'w/player_' || ln ELSE 't' END AS track_id,
      'white' AS jersey_color, CAST(ln AS VARCHAR) AS jersey_number, 'identified' AS identity_status FROM j WHERE ln IS NOT NULL
    UNION ALL SELECT DISTINCT source_video_id, material_id, 'old', 'player_0', NULL, NULL, 'anonymous' FROM j
      WHERE source_video_id NOT IN (SELECT source_video_id FROM j WHERE ln IS NOT NULL)""",
)
def finalize_references_query(v: Views) -> DataFrame:
    return cat.finalize(*_final_inputs(v))[1].drop("player_name")


_REGISTERED = _FINAL + """,
    seen AS (SELECT DISTINCT source_video_id FROM j WHERE ln IS NOT NULL),
    refs AS (SELECT DISTINCT source_video_id, material_id, 'p' || ln AS participant_id, CASE WHEN ln <= 3 THEN 'w/player_' || ln ELSE 't' END AS track_id,
        'white' AS jersey_color, CAST(ln AS VARCHAR) AS jersey_number, 'identified' AS identity_status FROM j WHERE ln IS NOT NULL
      UNION ALL SELECT DISTINCT source_video_id, material_id, 'old', 'player_0', NULL, NULL, 'anonymous' FROM j WHERE source_video_id NOT IN (FROM seen))"""


def _registered(v: Views) -> cat.Catalog:
    drafts, events, identities, references = _final_inputs(v)
    exported = drafts.select("*", F.lit("a.mp4").alias("video_path"), F.lit(0.0).alias("start_seconds"), F.lit(2.0).alias("end_seconds"))
    return cat.register_final(v.catalog, exported, events, identities, references, F.lit("2024-06-01 00:00:00"))


@query(
    "finalize_materials",
    _REGISTERED + """ SELECT material_id, source_video_id, 'ready' AS processing_status,
      to_json({'event_ids': list(event_id ORDER BY event_id), 'boundary_source': 'event_timeline',
        'identity_available': material_id IN (SELECT material_id FROM refs)})::VARCHAR AS metadata_json
    FROM e GROUP BY material_id, source_video_id""",
)
def finalize_materials_query(v: Views) -> DataFrame:
    return _registered(v).materials.select("material_id", "source_video_id", "processing_status", "metadata_json")


@query(
    "finalize_participants",
    _REGISTERED + """, s AS (SELECT participant_id, arg_max({'c': jersey_color, 'n': jersey_number, 's': identity_status}, source_video_id || ' ' || material_id || ' ' || track_id) AS x FROM refs GROUP BY 1)
    SELECT coalesce(s.participant_id, p.participant_id) AS participant_id, CASE WHEN s.participant_id IS NULL THEN p.jersey_color ELSE x.c END AS jersey_color,
      CASE WHEN s.participant_id IS NULL THEN p.jersey_number ELSE x.n END AS jersey_number,
      CASE WHEN s.participant_id IS NOT NULL THEN to_json({'identity_status': x.s})::VARCHAR END AS new_metadata
    FROM participants p FULL JOIN s ON s.participant_id = p.participant_id""",
)
def finalize_participants_query(v: Views) -> DataFrame:
    saved = F.col("updated_at") == "2024-06-01 00:00:00"
    return _registered(v).participants.select("participant_id", "jersey_color", "jersey_number", F.when(saved, F.col("metadata_json")).alias("new_metadata"))


@query(
    "build_final_materials",
    """SELECT 'm' || o_orderkey AS material_id, CASE WHEN EXISTS (SELECT 1 FROM predictions p WHERE p.material_id = 'm' || o_orderkey
        AND event <> 'blank') THEN 'ready' ELSE 'ready_without_event' END AS processing_status FROM orders""",
)
def build_final_query(v: Views) -> DataFrame:
    drafts = v.catalog.materials.select("material_id", "source_video_id", "video_path", "start_seconds", "end_seconds")
    events = v.predictions.select(
        "material_id", F.col("pos").alias("event_seq"), "event", "confidence",
        F.lit(None).cast("string").alias("global_track_id"), "participant_id", "identity_status",
        F.lit(0.0).alias("evidence_start_seconds"), F.lit(1.0).alias("evidence_end_seconds"),
    )
    people = v.catalog.material_participants
    return cat.build_final_materials(drafts, events, people)[0].select("material_id", "processing_status")


@query(
    "material_index",
    """SELECT 'm' || o_orderkey AS material_id, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'a.mp4' END, '') AS video_path,
      CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE o_totalprice/1000 END AS start_seconds, o_totalprice/1000 + 12 AS end_seconds,
      coalesce(ids, '') AS events
    FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('e' || l_linenumber, ',' ORDER BY l_linenumber) AS ids
      FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 5) GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def material_index_query(v: Views) -> DataFrame:
    ids = v.table("lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda n: text("e", n)).alias("event_ids")
    )
    exported = v.table("orders").join(ids, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        text("m", F.col("o_orderkey")).alias("material_id"),
        F.when(F.col("o_orderstatus") != "P", "a.mp4").alias("video_path"),
        F.when(F.col("o_orderstatus") == "F", 1.0).alias("start_seconds"),
        F.lit(None).cast("double").alias("end_seconds"),
        "event_ids",
    )
    # Lines six and seven refer to events that do not exist.
    events = v.table("lineitem").filter("l_linenumber <= 5").select(
        text("e", F.col("l_linenumber")).alias("event_id"), F.lit("Foul").alias("event"), F.lit(0.5).alias("confidence")
    ).distinct()
    index = cat.material_index(exported, v.catalog.materials, events)
    return index.withColumn(
        "events", F.coalesce(F.array_join(F.transform("events", lambda e: e["event_id"]), ","), F.lit(""))
    )
