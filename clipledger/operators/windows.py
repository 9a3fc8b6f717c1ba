"""Window planning, assignment of points to windows, and sampling."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.boxes import is_box
from clipledger.functions.numbers import spread_positions
from clipledger.functions.text import numbered
from clipledger.operators.prefix import with_position

# Frames per bucket when positions are counted along a track.
FRAME_BUCKET = 4096


def _check_plan(window: float, overlap: float, min_tail: float) -> None:
    if window <= 0:
        raise ValueError("window must be positive")
    if not 0 <= overlap < window:
        raise ValueError("overlap must be in [0, window)")
    if not 0 <= min_tail <= window:
        raise ValueError("min_tail must be in [0, window]")


def _window_count(duration: Column, window: float, overlap: float, min_tail: float) -> Column:
    """Number of windows of a video, after a short tail joined its neighbour."""
    step = window - overlap
    planned = F.when(duration <= window, F.lit(1).cast("bigint")).otherwise(
        1 + F.ceil((duration - window) / step)
    )
    tail = duration - (planned - 1) * step
    return planned - F.when((planned > 1) & (tail < min_tail), 1).otherwise(0)


def plan_windows(
    videos: DataFrame, window: float = 12.0, overlap: float = 2.0, min_tail: float = 2.0
) -> DataFrame:
    """Overlapping windows of every video, one row each; a map, no shuffle."""
    _check_plan(window, overlap, min_tail)
    step = float(window - overlap)
    duration = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")).otherwise(
        F.raise_error(F.lit("video duration must be positive")).cast("double")
    )
    counted = videos.select(
        F.col("video_id").alias("source_video_id"),
        "fps",
        F.col("frame_count").cast("bigint").alias("frame_count"),
        duration.alias("duration"),
    ).withColumn("n", _window_count(F.col("duration"), window, overlap, min_tail))
    rows = counted.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("index")
    )
    start = F.col("index") * F.lit(step)
    natural_end = F.least(start + F.lit(float(window)), F.col("duration"))
    is_last = F.col("index") == F.col("n") - 1
    # Only a joined tail makes the last window stop short of the duration.
    joined_tail = is_last & (natural_end < F.col("duration"))
    end = F.when(is_last, F.col("duration")).otherwise(natural_end)
    rows = rows.select(
        numbered(F.concat("source_video_id", F.lit("_")), "index", 5).alias("segment_id"),
        "source_video_id",
        F.col("index").cast("int").alias("index"),
        start.alias("start_seconds"),
        end.alias("end_seconds"),
        F.least(F.rint(start * F.col("fps")).cast("bigint"), "frame_count").alias(
            "source_start_frame"
        ),
        F.when(joined_tail, F.col("frame_count"))
        .otherwise(F.least(F.rint(end * F.col("fps")).cast("bigint"), F.col("frame_count")))
        .alias("source_end_frame"),
        (end - start).alias("duration_seconds"),
    )
    return rows.withColumn("output_filename", F.concat("segment_id", F.lit(".mp4")))


def assign_windows(
    points: DataFrame,
    videos: DataFrame,
    at: str,
    window: float,
    overlap: float,
    min_tail: float,
) -> DataFrame:
    """Every half-open window that contains each point, by arithmetic on the time.

    The window plan itself is not joined; only the video's duration is looked
    up. Points outside the video get no row.
    """
    _check_plan(window, overlap, min_tail)
    step = float(window - overlap)
    count = _window_count(F.col("duration_seconds"), window, overlap, min_tail)
    lengths = videos.select("video_id", "duration_seconds", count.alias("__n"))
    t = F.col(at)
    final = F.col("__n") - 1
    first = F.least(
        final, F.greatest(F.lit(0).cast("bigint"), F.floor((t - window) / step) + 1)
    )
    last = F.least(final, F.floor(t / step))
    joined = points.join(lengths, "video_id").filter((t >= 0) & (t < F.col("duration_seconds")))
    rows = joined.withColumn("window_index", F.explode(F.sequence(first, last)))
    start = F.col("window_index") * F.lit(step)
    return rows.select(
        *points.columns,
        numbered(F.concat("video_id", F.lit("_")), "window_index", 5).alias("window_id"),
        F.col("window_index").cast("int").alias("window_index"),
        start.alias("window_start"),
        (t - start).alias("local_seconds"),
    )


def uniform_sample(
    boxes: DataFrame,
    count: int,
    prefix: str = "player",
    tracks: DataFrame | None = None,
    min_size: float = 1.0,
    form: str = "step",
    keys: Sequence[str] = ("clip_id", "track_id"),
) -> DataFrame:
    """At most ``count`` valid frames per track, spread evenly, never repeated.

    ``tracks`` optionally restricts to the tracks needed (semi join, so the
    restriction is applied before any position is counted).
    """
    if count <= 0:
        raise ValueError("count must be positive")
    valid = boxes.filter(
        F.col("track_id").startswith(prefix) & is_box(F.col("w"), F.col("h"), min_size)
    )
    if tracks is not None:
        valid = valid.join(tracks.select(*keys), list(keys), "left_semi")
    placed = with_position(
        valid,
        keys,
        [F.col("frame")],
        F.expr(f"frame div {FRAME_BUCKET}"),
        name="__pos",
        total="__n",
    )
    index = F.array_position(spread_positions(F.col("__n"), count, form), F.col("__pos"))
    return (
        placed.withColumn("image_index", index.cast("int"))
        .filter(F.col("image_index") > 0)
        .drop("__pos", "__n")
    )


def crop_quality(area: Column, sharpness: Column) -> Column:
    size = F.sqrt(F.greatest(F.lit(1.0), area.cast("double")))
    return size * F.log1p(F.least(sharpness.cast("double"), F.lit(5000.0)))


def quality_binned_sample(
    crops: DataFrame, count: int, keys: Sequence[str] = ("clip_id", "track_id")
) -> DataFrame:
    """Best crop of each of ``count`` equal position bins, first one on a tie.

    ``crops`` holds the oversampled candidates (``frame``, ``area``,
    ``sharpness``), at most ``4 * count`` rows per track.
    """
    rated = crops.withColumn("quality_score", crop_quality(F.col("area"), F.col("sharpness")))
    placed = with_position(
        rated,
        keys,
        [F.col("frame")],
        F.expr(f"frame div {FRAME_BUCKET}"),
        name="__pos",
        total="__n",
    )
    bins = F.least(F.lit(count).cast("bigint"), F.col("__n"))
    placed = placed.withColumn(
        "bin", F.floor(((F.col("__pos") + 1) * bins - 1) / F.col("__n")).cast("int")
    )
    best = Window.partitionBy(*keys, "bin").orderBy(F.desc("quality_score"), "frame")
    return (
        placed.withColumn("__rank", F.row_number().over(best))
        .filter(F.col("__rank") <= 1)
        .drop("__rank", "__pos", "__n")
    )


def frame_stride(fps_in: float, fps_out: float) -> int:
    return max(1, int(round(fps_in / fps_out)))


def bag_starts(frames: Column, clip_len: int, stride: int, clips: int) -> Column:
    """Start frames of ``clips`` clips spread over a recording (repeats allowed)."""
    span = (clip_len - 1) * stride + 1
    last_start = F.greatest(F.lit(0), frames.cast("int") - span)
    if clips == 1:
        return F.array(F.floor(last_start / 2).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(clips - 1)),
        lambda i: F.rint(i * (last_start.cast("double") / (clips - 1))).cast("int"),
    )


def clip_frames(start: Column, frames: Column, clip_len: int, stride: int) -> Column:
    """Frame indices of one clip, clamped to the recording."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(clip_len - 1)),
        lambda i: F.greatest(
            F.lit(0), F.least(start.cast("int") + i * stride, frames.cast("int") - 1)
        ),
    )
