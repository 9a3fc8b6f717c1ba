"""Queries on windows, candidates, merged events and delivery ranges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.operators import timeline as tl
from clipledger.operators.catalog import Catalog, find_materials
from clipledger.operators.windows import assign_windows
from clipledger.plans.registry import query
from clipledger.plans.views import OVERLAP, TAIL, WINDOW, Views
from clipledger.session import cut_lineage, shared_folder
from clipledger.streaming.timeline import close_stream, run_merge


@query(
    "plan_windows",
    """SELECT segment_id, source_video_id, index, start_seconds, end_seconds, source_start_frame,
      source_end_frame, end_seconds - start_seconds AS duration_seconds, segment_id || '.mp4' AS output_filename
    FROM windows""",
)
def plan_windows_query(v: Views) -> DataFrame:
    return v.windows


@query(
    "assign_windows",
    """SELECT event_id, segment_id AS window_id, index AS window_index, t - start_seconds AS local_seconds
    FROM evidence JOIN windows ON video_id = source_video_id AND t >= start_seconds AND t < end_seconds""",
)
def assign_windows_query(v: Views) -> DataFrame:
    return assign_windows(v.evidence, v.videos, "t", WINDOW, OVERLAP, TAIL).select(
        "event_id", "window_id", "window_index", "local_seconds"
    )


def _candidates(v: Views) -> DataFrame:
    return tl.collect_candidates(v.windows, v.claims)[0]


@query("collect_candidates", "SELECT * FROM candidates")
def candidates_query(v: Views) -> DataFrame:
    return _candidates(v)


def _flat(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "source_video_id",
        "event",
        "global_track_id",
        "confidence",
        "temporal_score",
        "evidence_start_seconds",
        "evidence_end_seconds",
        F.array_join("candidate_ids", ",").alias("candidate_ids"),
        F.array_join("track_references", ",").alias("track_references"),
    )


@query(
    "merged_islands",
    """SELECT printf('%s:event_%05d', source_video_id, event_index) AS event_id, source_video_id, event,
      global_track_id, confidence, temporal_score, start AS evidence_start_seconds, end_ AS evidence_end_seconds,
      candidate_ids, track_references FROM island_events""",
)
def merged_islands_query(v: Views) -> DataFrame:
    return _flat(tl.merge_islands(_candidates(v)))


@query(
    "merged_exact",
    """SELECT printf('%s:event_%05d', source_video_id, event_index) AS event_id, source_video_id, event,
      global_track_id, confidence, temporal_score, start AS evidence_start_seconds, end_ AS evidence_end_seconds,
      candidate_ids, track_references FROM exact_events""",
)
def merged_exact_query(v: Views) -> DataFrame:
    return _flat(tl.merge_candidates(_candidates(v)))


@query(
    "merged_stream",
    """SELECT printf('%s:event_%05d', source_video_id, event_index) AS event_id, source_video_id, event,
      global_track_id, confidence, temporal_score, start AS evidence_start_seconds, end_ AS evidence_end_seconds,
      candidate_ids, track_references FROM exact_events""",
)
def merged_stream_query(v: Views) -> DataFrame:
    """The exact merge as a stream of six micro-batches; every seventh claim arrives a batch late."""
    candidates = cut_lineage(_candidates(v))
    span = (candidates.agg(F.max("global_start_seconds")).first()[0] or 0.0) / 5 + 1
    late = F.pmod(F.xxhash64("candidate_id"), F.lit(7)) == 0
    slot = F.floor(F.col("global_start_seconds") / span) + late.cast("int")
    base = shared_folder(v.spark)
    files = _files_a_batch(candidates, slot)
    for k in range(6):
        part = candidates.filter(slot == k)
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(f"{base}/in")
    for _ in range(2):  # the first moves the watermark, the second is a batch that sees it moved
        close_stream(candidates, files=files).write.mode("append").parquet(f"{base}/in")
    final = run_merge(v.spark, f"{base}/in", candidates.schema, f"{base}/out", f"{base}/checkpoint", delay_seconds=span, files=files)
    return _flat(tl.summarise(final))


def _files_a_batch(candidates: DataFrame, slot: Column, rows: int = 20_000) -> int:
    """Files that each of the six batches can be written to, each of about ``rows`` or more, so that none is empty."""
    least = candidates.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count("n")).first()
    return max(1, least[0] // rows) if least[1] == 6 else 1


_PADDED = """SELECT i.*, duration_seconds,
      CASE WHEN event IN ('Missed Shot','Made Shot') THEN 5.0 WHEN event = 'ast' THEN 7.0 ELSE 4.0 END::DOUBLE AS pre,
      CAST(2.0 AS DOUBLE) AS post
    FROM island_events i JOIN videos ON video_id = source_video_id"""


@query(
    "material_drafts",
    f"""SELECT printf('%s:material_%05d', source_video_id, event_index) AS material_id, source_video_id,
      greatest(0.0, start - pre) AS start_seconds, least(duration_seconds, end_ + post) AS end_seconds,
      printf('%s:event_%05d', source_video_id, event_index) AS event_ids,
      'event_evidence_with_type_padding' AS boundary_method, pre AS pre_roll_seconds, post AS post_roll_seconds,
      least(duration_seconds, end_ + post) - greatest(0.0, start - pre) AS duration_seconds
    FROM ({_PADDED})""",
)
def material_drafts_query(v: Views) -> DataFrame:
    drafts = tl.material_drafts(tl.merge_islands(_candidates(v)), v.videos)
    return drafts.withColumn("event_ids", F.array_join("event_ids", ","))


@query(
    "build_timeline",
    f"""SELECT printf('%s:material_%05d', source_video_id, event_index) AS material_id, source_video_id,
      greatest(0.0, start - pre) AS start_seconds, least(duration_seconds, end_ + post) AS end_seconds,
      printf('%s:event_%05d', source_video_id, event_index) AS event_ids,
      'event_evidence_with_type_padding' AS boundary_method, pre AS pre_roll_seconds, post AS post_roll_seconds,
      least(duration_seconds, end_ + post) - greatest(0.0, start - pre) AS duration_seconds
    FROM ({_PADDED.replace("island_events", "exact_events")})""",
)
def build_timeline_query(v: Views) -> DataFrame:
    built = tl.build_timeline(v.windows, v.claims, v.videos)
    return built["material_drafts"].withColumn("event_ids", F.array_join("event_ids", ","))


@query(
    "event_material_search",
    f"""SELECT printf('%s:material_%05d', source_video_id, event_index) AS material_id, source_video_id,
      greatest(0.0, start - pre) AS start_seconds, least(duration_seconds, end_ + post) AS end_seconds
    FROM ({_PADDED}) WHERE event = 'Made Shot' AND confidence >= 0.5""",
)
def event_material_search(v: Views) -> DataFrame:
    """Plan windows, merge claims, pad them and search: materials of one event."""
    events = tl.merge_islands(_candidates(v))
    drafts = tl.material_drafts(events, v.videos)
    tags = events.select(
        F.format_string("%s:material_%05d", "source_video_id", "event_index").alias("material_id"),
        F.col("event").alias("event_name"),
        "confidence",
        F.lit(None).cast("string").alias("participant_id"),
    )
    catalog = Catalog(tags, drafts, tags, tags)
    return find_materials(catalog, event="Made Shot", minimum_confidence=0.5).select(
        "material_id", "source_video_id", "start_seconds", "end_seconds"
    )


@query(
    "normalize_temporal_events",
    """SELECT event_id, video_id, track AS player_id, event, t AS start_time,
      CASE WHEN value > 400 THEN t - 1 ELSE t + len END AS end_time, confidence
    FROM evidence WHERE event <> 'blank' AND value <= 400 AND event_type <> 'signup'""",
)
def normalize_temporal_events_query(v: Views) -> DataFrame:
    start = F.when(F.col("event_type") == "signup", F.lit("soon")).otherwise(F.col("t").cast("string"))
    end = F.when(F.col("value") > 400, F.col("t") - 1).otherwise(F.col("t") + F.col("len"))
    raw = v.evidence.select(
        "event_id",
        "video_id",
        F.col("track").alias("player_id"),
        F.when(F.col("event") == "blank", F.lit("  ")).otherwise(F.concat(F.lit(" "), "event")).alias("event"),
        start.alias("start_time"),
        end.cast("string").alias("end_time"),
        F.col("confidence").cast("string").alias("confidence"),
    )
    return tl.normalize_temporal_events(raw).drop("sort_key")


@query(
    "active_events",
    """SELECT w.segment_id, w.start_seconds AS t, event_id FROM windows w JOIN evidence e
      ON e.video_id = w.source_video_id AND e.t <= w.start_seconds AND w.start_seconds < e.t + e.len""",
)
def active_events_query(v: Views) -> DataFrame:
    instants = v.windows.select(
        F.col("source_video_id").alias("video_id"), "segment_id", F.col("start_seconds").alias("t")
    )
    events = v.evidence.select(
        "video_id", "event_id", F.col("t").alias("start_time"), (F.col("t") + F.col("len")).alias("end_time")
    )
    return tl.active_events(events, instants).select("segment_id", "t", "event_id")


