"""From per-window event claims to one timeline of merged events per video."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.text import literal_map, numbered, strip
from clipledger.operators.conflicts import SEGMENT_SECONDS, assign_groups
from clipledger.operators.guards import stop_unless
from clipledger.operators.prefix import interval_join, with_position
from clipledger.session import cut_lineage
from clipledger.vocabulary import BOUNDARY_METHOD, DEFAULT_PADDING, PADDING_SECONDS

# Seconds per bucket when events of one video are walked in time order. A video
# has at most duration / TIME_BUCKET buckets, and one bucket is one task's share.
TIME_BUCKET = 60.0

GROUP = ["source_video_id", "event"]
ORDER = ["global_start_seconds", "event", "window_id", "local_track_id", "candidate_id"]


def _time_bucket(column: str, width: float = TIME_BUCKET) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def collect_candidates(
    windows: DataFrame, events: DataFrame, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Map the claims of each window onto the source timeline.

    ``windows`` has ``segment_id, source_video_id, start_seconds,
    duration_seconds``; ``events`` has ``window_id, pos`` and the claim. Returns
    the candidates and the claims with an empty range; with ``strict`` such a
    claim stops the query instead.
    """
    claims = events.filter(
        F.col("event").isNotNull() & ~F.col("event").isin("", "blank")
    )
    joined = claims.join(
        windows.select(
            F.col("segment_id").alias("window_id"),
            "source_video_id",
            F.col("start_seconds").alias("__start"),
            F.col("duration_seconds").alias("__length"),
        ),
        "window_id",
    )
    local_start = F.greatest(F.lit(0.0), F.coalesce("start_time", F.lit(0.0)))
    local_end = F.least(F.col("__length"), F.coalesce("end_time", F.lit(0.0)))
    confidence = F.coalesce("confidence", F.lit(0.0))
    score = F.col("temporal_score")
    track = F.coalesce(
        F.nullif("source_track_id", F.lit("")),
        F.nullif("player_id", F.lit("")),
        F.lit("unknown"),
    )
    mapped = joined.select(
        numbered(F.concat("window_id", F.lit(":event_")), "pos", 4).alias("candidate_id"),
        "source_video_id",
        "window_id",
        track.alias("local_track_id"),
        "global_track_id",
        "event",
        confidence.alias("confidence"),
        F.when(score.isNull() | (score == 0), confidence).otherwise(score).alias("temporal_score"),
        local_start.alias("local_start_seconds"),
        local_end.alias("local_end_seconds"),
        (F.col("__start") + local_start).alias("global_start_seconds"),
        (F.col("__start") + local_end).alias("global_end_seconds"),
    )
    good = F.col("local_end_seconds") > F.col("local_start_seconds")
    rejected = mapped.filter(~good)
    if strict:
        return stop_unless(mapped, good, F.concat(F.lit("empty event range in "), "candidate_id")), rejected
    return mapped.filter(good), rejected


def mark_islands(
    candidates: DataFrame, gap: float = 0.5, bucket_seconds: float = TIME_BUCKET
) -> DataFrame:
    """Add ``island``: the first candidate of each run without a larger gap.

    A run opens where a candidate starts later than everything before it plus
    ``gap``. A long video is cut into time buckets. Inside a bucket only local
    ends are known, which gives locally opening rows; the real ones are those
    that also start after the end carried in. Starts never decrease, so the last
    local opening decides what a bucket passes on, and one row per bucket is
    enough to carry both the end and the island forward.
    """
    if gap < 0:
        raise ValueError("gap must not be negative")
    bucket = [*GROUP, "__bucket"]
    order = [F.col(c) for c in ORDER]
    inside = Window.partitionBy(*bucket).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("global_start_seconds")

    local = candidates.withColumn(
        "__bucket", _time_bucket("global_start_seconds", bucket_seconds)
    ).withColumn("__end", F.max("global_end_seconds").over(before))
    local = local.withColumn("__opens", F.col("__end").isNull() | (start > F.col("__end") + gap))

    earlier = Window.partitionBy(*GROUP).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        local.groupBy(*bucket)
        .agg(
            F.max("global_end_seconds").alias("__reach"),
            # Openings have strictly increasing starts, so the start orders them.
            F.max(
                F.when(F.col("__opens"), F.struct("global_start_seconds", "candidate_id"))
            ).alias("__last"),
        )
        .withColumn("__carry", F.max("__reach").over(earlier))
    )
    opened = F.col("__carry").isNull() | (
        F.col("__last.global_start_seconds") > F.col("__carry") + gap
    )
    carried = carried.withColumn(
        "__island", F.max(F.when(opened, F.col("__last"))).over(earlier)
    ).select(*bucket, "__carry", "__island")

    joined = local.join(carried, bucket)
    opens = F.col("__opens") & (F.col("__carry").isNull() | (start > F.col("__carry") + gap))
    latest = F.last(F.when(opens, F.col("candidate_id")), ignorenulls=True).over(upto)
    return joined.withColumn("island", F.coalesce(latest, F.col("__island.candidate_id"))).drop(
        "__bucket", "__end", "__opens", "__carry", "__island"
    )


def merge_islands(
    candidates: DataFrame, gap: float = 0.5, bucket_seconds: float = TIME_BUCKET
) -> DataFrame:
    """Merged events when no window holds two tracks of one event (fast form)."""
    marked = mark_islands(candidates, gap, bucket_seconds).withColumn("__group", F.col("island"))
    return summarise(marked, bucket_seconds)


def merge_candidates(
    candidates: DataFrame, gap: float = 0.5, bucket_seconds: float = TIME_BUCKET, segment_seconds: float = SEGMENT_SECONDS
) -> DataFrame:
    """Merge repeated claims of overlapping windows into events.

    A candidate joins the latest group of its video and event that it touches
    and that has no other track from the same window and no other global track.
    No group can reach across an island, and an island without any conflict is
    one group, so both are decided natively. Only islands with a conflict need
    the ordered rule, which runs over segments of time (``conflicts``).
    """
    # Read several times below, so it is written once to shared storage.
    marked = cut_lineage(mark_islands(candidates, gap, bucket_seconds))
    keys = [*GROUP, "island"]
    per_window = marked.groupBy(*keys, "window_id").agg(
        (F.min("local_track_id") != F.max("local_track_id")).alias("clash"),
        F.min("global_track_id").alias("lo"),
        F.max("global_track_id").alias("hi"),
    )
    state = per_window.groupBy(*keys).agg(
        (F.max("clash") | F.coalesce(F.min("lo") != F.max("hi"), F.lit(False))).alias("__conflict")
    )
    flagged = marked.join(state, keys)
    simple = flagged.filter(~F.col("__conflict")).drop("__conflict").withColumn("__group", F.col("island"))
    ordered = flagged.filter("__conflict").drop("__conflict")
    folded = assign_groups(ordered, keys, ORDER, gap, segment_seconds)
    return summarise(simple.unionByName(folded), bucket_seconds)


def summarise(grouped: DataFrame, bucket_seconds: float = TIME_BUCKET) -> DataFrame:
    """One row per ``__group`` of candidates, numbered per video by its first candidate."""
    first = F.min(F.struct(*ORDER))
    arrival = F.array_sort(
        F.collect_list(F.struct(*ORDER, F.concat_ws("/", "window_id", "local_track_id").alias("ref")))
    )
    events = grouped.groupBy(*GROUP, "__group").agg(
        F.max("global_track_id").alias("global_track_id"),
        F.max("confidence").alias("confidence"),
        F.max("temporal_score").alias("temporal_score"),
        F.min("global_start_seconds").alias("evidence_start_seconds"),
        F.max("global_end_seconds").alias("evidence_end_seconds"),
        first.alias("__first"),
        arrival.alias("__arrival"),
    )
    placed = with_position(
        cut_lineage(events),
        ["source_video_id"],
        [F.col("__first")],
        _time_bucket("evidence_start_seconds", bucket_seconds),
        name="event_index",
    )
    return placed.select(
        numbered(F.concat("source_video_id", F.lit(":event_")), "event_index", 5).alias("event_id"),
        "source_video_id",
        "event_index",
        "event",
        "global_track_id",
        "confidence",
        "temporal_score",
        "evidence_start_seconds",
        "evidence_end_seconds",
        F.col("__arrival.candidate_id").alias("candidate_ids"),
        F.col("__arrival.ref").alias("track_references"),
    )


def material_drafts(events: DataFrame, videos: DataFrame) -> DataFrame:
    """One padded delivery range per event, kept inside the recording.

    The padding is a constant lookup; only the duration is joined.
    """
    default_pre, default_post = DEFAULT_PADDING
    pre_roll = F.coalesce(
        F.try_element_at(literal_map({k: v[0] for k, v in PADDING_SECONDS.items()}), "event"),
        F.lit(default_pre),
    )
    post_roll = F.coalesce(
        F.try_element_at(literal_map({k: v[1] for k, v in PADDING_SECONDS.items()}), "event"),
        F.lit(default_post),
    )
    lengths = videos.select(
        F.col("video_id").alias("source_video_id"),
        F.col("duration_seconds").alias("__duration"),
    )
    joined = stop_unless(events.join(lengths, "source_video_id"), F.col("__duration") > 0, F.lit("video duration must be positive"))
    padded = joined.select(
        "*", pre_roll.alias("pre_roll_seconds"), post_roll.alias("post_roll_seconds")
    )
    start = F.greatest(F.lit(0.0), F.col("evidence_start_seconds") - F.col("pre_roll_seconds"))
    end = F.least(F.col("__duration"), F.col("evidence_end_seconds") + F.col("post_roll_seconds"))
    return padded.select(
        numbered(F.concat("source_video_id", F.lit(":material_")), "event_index", 5).alias("material_id"),
        "source_video_id",
        start.alias("start_seconds"),
        end.alias("end_seconds"),
        F.array("event_id").alias("event_ids"),
        F.lit(BOUNDARY_METHOD).alias("boundary_method"),
        "pre_roll_seconds",
        "post_roll_seconds",
        (end - start).alias("duration_seconds"),
    )


def build_timeline(
    windows: DataFrame, claims: DataFrame, videos: DataFrame, gap: float = 0.5
) -> dict[str, DataFrame]:
    """Candidates, merged events and delivery ranges of all videos."""
    candidates, _ = collect_candidates(windows, claims)
    events = merge_candidates(candidates, gap)
    return {
        "candidates": candidates,
        "events": events,
        "material_drafts": material_drafts(events, videos),
    }


def normalize_temporal_events(raw: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Usable evidence rows of loosely typed reports; malformed rows are dropped.

    Times and confidence may be text. Rows come ordered by start, player, event
    within each video through ``sort_key``; sort by it when order matters.
    """
    start = F.col("start_time").try_cast("double")
    end = F.col("end_time").try_cast("double")
    missing = F.col("confidence").isNull()
    confidence = F.when(missing, 0.0).otherwise(F.col("confidence").try_cast("double"))
    cleaned = raw.select(
        *[c for c in raw.columns if c not in ("start_time", "end_time", "confidence", "event")],
        strip(F.col("event")).alias("event"),
        start.alias("start_time"),
        end.alias("end_time"),
        confidence.alias("confidence"),
    ).filter(
        "start_time >= 0 AND end_time > start_time AND confidence IS NOT NULL AND event <> ''"
    )
    return cleaned.withColumn(
        "sort_key", F.struct(*keys, "start_time", F.coalesce("player_id", F.lit("")).alias("player"), "event")
    )


def active_events(events: DataFrame, instants: DataFrame, width: float = 60.0) -> DataFrame:
    """Evidence intervals ``[start, end)`` containing each instant of their video."""
    return interval_join(
        instants, events, ["video_id"], "t", "start_time", "end_time", width, False
    )
