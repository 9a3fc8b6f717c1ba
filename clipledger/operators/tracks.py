"""Operators on object tracks stored as one row per (clip, track, frame)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.boxes import is_box, is_finite_box, scaled
from clipledger.operators.prefix import exact_median, interval_join, with_previous
from clipledger.operators.windows import FRAME_BUCKET

TRACK = ["clip_id", "track_id"]


def mask_bounds(pixels: DataFrame) -> DataFrame:
    """Tight box of the positive pixels of each object and frame.

    Objects without a positive pixel keep a row with a NULL box.
    """
    on = F.col("value") > 0
    x, y = F.when(on, F.col("px")), F.when(on, F.col("py"))
    return pixels.groupBy("clip_id", "kind", "object_id", "frame").agg(
        F.min(x).alias("x"),
        F.min(y).alias("y"),
        (F.max(x) - F.min(x) + 1).alias("w"),
        (F.max(y) - F.min(y) + 1).alias("h"),
    )


def densify_tracks(boxes: DataFrame, frame_counts: DataFrame | None = None) -> DataFrame:
    """Full frame grid per object, NULL where no box exists, with dense names.

    ``boxes`` has ``clip_id, kind, object_id, frame, x, y, w, h``. Players are
    renamed ``player_0..``, balls ``ball_1..`` in numeric object order. The
    frame count is given per clip, or the last frame over both kinds plus one.
    """
    if frame_counts is None:
        frame_counts = boxes.groupBy("clip_id").agg((F.max("frame") + 1).alias("n_frames"))
    objects = boxes.select("clip_id", "kind", "object_id").distinct()
    order = Window.partitionBy("clip_id", "kind").orderBy("object_id")
    number = F.dense_rank().over(order) - F.when(F.col("kind") == "player", 1).otherwise(0)
    named = objects.withColumn(
        "track_id", F.concat("kind", F.lit("_"), number.cast("string"))
    ).join(frame_counts.select("clip_id", "n_frames"), "clip_id")
    grid = named.filter("n_frames > 0").select(
        "clip_id",
        "kind",
        "object_id",
        "track_id",
        F.explode(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).alias("frame"),
    )
    seen = boxes.select(
        "clip_id", "kind", "object_id", F.col("frame").cast("int").alias("frame"), "x", "y", "w", "h"
    )
    return grid.join(seen, ["clip_id", "kind", "object_id", "frame"], "left").select(
        "clip_id", "track_id", "frame", "x", "y", "w", "h"
    )


def topk_objects(scores: DataFrame, k: int) -> DataFrame:
    """Flag the ``k`` most confident objects of each prompt; earlier position wins ties.

    The kept rows are found with a limited rank (trimmed before the shuffle);
    all other objects stay in the result as removed.
    """
    keys = ["session_id", "prompt"]
    order = Window.partitionBy(*keys).orderBy(F.desc("probability"), "pos")
    kept = (
        scores.select(*keys, "pos", "probability")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*keys, "pos", "rank")
    )
    return scores.join(kept, [*keys, "pos"], "left").withColumn(
        "kept", F.col("rank").isNotNull()
    )


def track_statistics(boxes: DataFrame, min_size: float = 0.0) -> DataFrame:
    """Valid box count and length of every track."""
    return boxes.groupBy(*TRACK).agg(
        F.count_if(is_box(F.col("w"), F.col("h"), min_size)).alias("valid_bbox_count"),
        (F.max("frame") + 1).cast("int").alias("n_frames"),
    )


def prepare_tracks(boxes: DataFrame) -> DataFrame:
    """One row per track to keep: all usable players and one ball per clip.

    A player stays when any of its boxes is valid, whatever its identity. The
    ball is the candidate with most valid boxes (larger id on a tie); a clip
    without candidates gets an empty ball as long as its longest track.
    """
    stats = track_statistics(boxes)
    players = stats.filter(
        F.col("track_id").startswith("player_") & (F.col("valid_bbox_count") > 0)
    ).select(
        "clip_id",
        "track_id",
        F.col("track_id").alias("source_track_id"),
        F.lit("unresolved").alias("identity_status"),
        "valid_bbox_count",
        "n_frames",
    )
    is_ball = (F.col("track_id") == "ball") | F.col("track_id").startswith("ball_")
    choice = F.max(
        F.when(is_ball, F.struct("valid_bbox_count", "track_id", "n_frames"))
    )
    balls = stats.groupBy("clip_id").agg(
        choice.alias("best"), F.max("n_frames").alias("longest")
    )
    balls = balls.select(
        "clip_id",
        F.lit("ball").alias("track_id"),
        F.col("best.track_id").alias("source_track_id"),
        F.lit(None).cast("string").alias("identity_status"),
        F.coalesce("best.valid_bbox_count", F.lit(0)).alias("valid_bbox_count"),
        F.coalesce("best.n_frames", "longest").alias("n_frames"),
    )
    return players.unionByName(balls)


def prepared_boxes(boxes: DataFrame, prepared: DataFrame) -> DataFrame:
    """Boxes of the prepared tracks, NULL where a source box is not valid."""
    chosen = prepared.filter("source_track_id IS NOT NULL").select(
        "clip_id", F.col("track_id").alias("__name"), F.col("source_track_id").alias("track_id")
    )
    ok = is_box(F.col("w"), F.col("h"))
    return boxes.join(chosen, TRACK).select(
        "clip_id",
        F.col("__name").alias("track_id"),
        "frame",
        *[F.when(ok, F.col(c)).alias(c) for c in "xywh"],
    )


def track_report(prepared: DataFrame) -> DataFrame:
    """Per clip: player count, sorted player ids and the chosen ball."""
    player = F.col("track_id") != "ball"
    return prepared.groupBy("clip_id").agg(
        F.count_if(player).alias("player_count"),
        F.array_sort(F.collect_set(F.when(player, F.col("track_id")))).alias("player_ids"),
        F.max(F.when(~player, F.col("source_track_id"))).alias("selected_ball_track_id"),
    )


def ball_statistics(boxes: DataFrame) -> DataFrame:
    """Size, motion and continuity of every ball candidate, with its score."""
    valid = boxes.filter(
        F.col("track_id").startswith("ball") & is_box(F.col("w"), F.col("h"), 1.0)
    ).select(
        *TRACK,
        "frame",
        "w",
        "h",
        (F.col("x") + F.col("w") / 2).alias("cx"),
        (F.col("y") + F.col("h") / 2).alias("cy"),
    )
    stats = valid.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg("w").alias("mean_width"),
        F.avg("h").alias("mean_height"),
        F.avg(F.col("w") * F.col("h")).alias("mean_area"),
        F.avg(F.col("w") / F.greatest("h", F.lit(1e-6))).alias("aspect"),
        F.hypot(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("move_range"),
    )
    steps = with_previous(
        valid, TRACK, ["frame"], F.expr(f"frame div {FRAME_BUCKET}"), ["frame", "cx", "cy"]
    ).filter("previous IS NOT NULL")
    speeds = steps.select(
        *TRACK,
        (
            F.hypot(F.col("cx") - F.col("previous.cx"), F.col("cy") - F.col("previous.cy"))
            / (F.col("frame") - F.col("previous.frame"))
        ).alias("speed"),
    )
    # steps of about a hundredth of the value: narrow for slow objects, too
    step = F.coalesce(F.floor(F.log2("speed") * 64), F.lit(-(1 << 20)))
    medians = exact_median(speeds, TRACK, "speed", step, "median_speed")
    joined = stats.join(medians, TRACK, "left").withColumn(
        "median_speed", F.coalesce("median_speed", F.lit(0.0))
    )
    width, height = F.col("mean_width"), F.col("mean_height")
    size = (
        F.when((width < 6) | (height < 6), 0.2).otherwise(1.0)
        * F.when((width > 50) | (height > 50), 0.15).otherwise(1.0)
        * F.when(F.col("mean_area") > 2500, 0.05).otherwise(1.0)
    )
    one = F.lit(1.0)
    aspect = F.least(one, F.greatest(F.lit(0.0), 1.4 - F.abs(F.col("aspect") - 1.0)))
    motion = F.least(one, F.col("move_range") / 500.0)
    speed = F.least(one, F.col("median_speed") / 10.0)
    continuity = F.least(one, F.col("n_frames") / 80.0)
    score = 0.30 * size + 0.20 * aspect + 0.20 * motion + 0.20 * speed + 0.10 * continuity
    return joined.withColumn("heuristic_score", score)


def rank_ball_candidates(boxes: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` best ball candidates of every clip."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("heuristic_score"), "track_id")
    return (
        ball_statistics(boxes)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )


def single_ball_or_none(boxes: DataFrame) -> DataFrame:
    """Per clip the ball track, only when exactly one candidate has a usable box."""
    usable = boxes.filter(
        F.col("track_id").startswith("ball") & is_box(F.col("w"), F.col("h"), 1.0)
    )
    first, last = F.min("track_id"), F.max("track_id")
    chosen = usable.groupBy("clip_id").agg(
        F.when(first == last, first).alias("selected_ball_id")
    )
    return boxes.select("clip_id").distinct().join(chosen, "clip_id", "left")


def mask_segment(boxes: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the boxes inside a chosen frame range of a raw track.

    ``segments`` has ``clip_id, raw_track_id, output_track_id, start_frame,
    end_frame``. Returns the masked boxes (other frames are NULL, the length is
    unchanged) and one audit row per segment; only segments with status ``ok``
    appear among the boxes.
    """
    wanted = segments.withColumnRenamed("raw_track_id", "track_id")
    joined = wanted.join(boxes, TRACK, "left")
    valid = is_finite_box(*[F.col(c) for c in "xywh"], min_size=1.0)
    inside = valid & F.col("frame").between(F.col("start_frame"), F.col("end_frame"))
    keys = [*TRACK, "output_track_id", "start_frame", "end_frame"]
    stats = joined.groupBy(*keys).agg(
        (F.max("frame") + 1).cast("int").alias("source_trajectory_length"),
        F.count_if(valid).alias("source_valid_bbox_count"),
        F.count_if(inside).alias("retained_valid_bbox_count"),
        F.min(F.when(inside, F.col("frame"))).alias("first_retained_frame"),
        F.max(F.when(inside, F.col("frame"))).alias("last_retained_frame"),
    )
    status = (
        F.when(~F.col("output_track_id").startswith("player_"), "invalid_output_track")
        .when(
            (F.col("start_frame") < 0) | (F.col("end_frame") < F.col("start_frame")),
            "invalid_range",
        )
        .when(F.col("source_trajectory_length").isNull(), "missing_track")
        .when(F.col("end_frame") >= F.col("source_trajectory_length"), "range_exceeds_track")
        .when(F.col("retained_valid_bbox_count") == 0, "no_valid_boxes")
        .otherwise("ok")
    )
    stats = stats.withColumn("status", status)
    accepted = stats.filter("status = 'ok'").select(*keys)
    masked = joined.join(accepted, keys, "left_semi").select(
        "clip_id",
        F.col("output_track_id").alias("track_id"),
        "frame",
        *[F.when(inside, F.col(c)).alias(c) for c in "xywh"],
    )
    return masked, stats.withColumnRenamed("track_id", "raw_track_id")


def _box_hashes() -> dict[str, Column]:
    fields = ["frame", "x", "y", "w", "h"]
    return {c: F.xxhash64(F.lit(c), *fields).alias(f"__{c}") for c in ("a", "b")}


def _signature(a: Column | str, b: Column | str, n: Column | str) -> Column:
    a, b, n = (F.col(x) if isinstance(x, str) else x for x in (a, b, n))
    return F.concat_ws(":", F.hex(a), F.hex(b), n.cast("string"))


def trajectory_signatures(boxes: DataFrame) -> DataFrame:
    """A 128-bit signature per track: equal trajectories get equal signatures.

    Per-frame hashes are combined with XOR, so it aggregates partially and no
    trajectory is ever gathered.
    """
    a, b = _box_hashes().values()
    return boxes.groupBy(*TRACK).agg(
        _signature(F.bit_xor(a), F.bit_xor(b), F.count(F.lit(1))).alias("signature")
    )


def match_tracks(clean_tracks: DataFrame, clean_boxes: DataFrame, raw_boxes: DataFrame) -> DataFrame:
    """Match clean player tracks back to raw ones, each raw track at most once.

    A clean track names its source, or is compared by trajectory. Clean tracks
    claim in id order; a claim succeeds when exactly one candidate is still
    free. Candidates of one clean track always share a raw signature, so claims
    only interact inside one signature group, where the sequential rule has a
    closed form:

    * a named source is claimed by its first clean track, unless the group's
      last free raw track already went to an unnamed one;
    * the first unnamed clean track reached when all but one raw track of the
      group are claimed takes the remaining one.

    So a group is walked once: a raw track comes where its first named claim is, at
    the end without one, and the last raw track is the one an unnamed winner gets.
    Rows carry ``candidate_group``; its members are in ``candidate_groups``.
    """
    group = ["clip_id", "__a", "__b", "__n"]
    events = _claim_events(clean_tracks, clean_boxes, raw_boxes)
    walk = Window.partitionBy(*group).orderBy(F.col("clean_track_id").asc_nulls_last())
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    whole = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = events.select(
        "*",
        F.coalesce(F.count("member").over(before), F.lit(0)).alias("claimed_before"),
        F.count("member").over(whole).alias("group_size"),
        F.last("member", ignorenulls=True).over(whole).alias("last_member"),
    ).withColumn("takes_last", ~F.col("named") & (F.col("claimed_before") == F.col("group_size") - 1))
    taken_before = F.coalesce(F.max("takes_last").over(before), F.lit(False))
    walked = walked.withColumn("matched", (F.col("member").isNotNull() | F.col("takes_last")) & ~taken_before)
    known = F.col("__n").isNotNull() & (F.col("group_size") > 0)
    return walked.filter("clean_track_id IS NOT NULL").select(
        "clip_id",
        "clean_track_id",
        F.when(~known, "unmatched").when(F.col("matched"), "matched").otherwise("ambiguous").alias("status"),
        F.when(F.col("named"), "source_track_id").otherwise("trajectory_signature").alias("method"),
        F.when(known & F.col("matched"), F.coalesce("member", "last_member")).alias("raw_track_id"),
        F.when(~known, 0).when(F.col("named"), 1).otherwise(F.col("group_size")).cast("bigint").alias("candidate_count"),
        F.when(known, _signature("__a", "__b", "__n")).alias("candidate_group"),
    )


def _claim_events(clean_tracks: DataFrame, clean_boxes: DataFrame, raw_boxes: DataFrame) -> DataFrame:
    """One row per claim, and per raw player that nobody names, with the signature of its group.

    ``member`` is the raw track that a row stands for: the first claim of a source has
    it, or a row without a clean track. Boxes of both sides are hashed in one
    aggregate, and a claim meets the track that it names, or its own boxes, in one join.
    """
    player = F.col("track_id").startswith("player_")
    sides = [
        boxes.filter(player).select(*TRACK, *hashed.values(), F.lit(side).alias("__raw"))
        for boxes, side, hashed in ((raw_boxes, True, _box_hashes()), (clean_boxes, False, _box_hashes()))
    ]
    signed = sides[0].unionByName(sides[1]).groupBy("clip_id", F.col("track_id").alias("__key")).agg(
        *[
            total(F.when(F.col("__raw") == raw, F.col(c))).alias(f"{c}{side}")
            for side, raw in (("_raw", True), ("_clean", False))
            for c, total in (("__a", F.bit_xor), ("__b", F.bit_xor))
        ],
        F.count_if("__raw").alias("__n_raw"),
        F.count_if(~F.col("__raw")).alias("__n_clean"),
    )
    named = F.col("source_track_id").isNotNull()
    claims = clean_tracks.filter(player).select(
        "clip_id",
        F.coalesce("source_track_id", "track_id").alias("__key"),
        F.col("track_id").alias("clean_track_id"),
        named.alias("named"),
    )
    of_key = Window.partitionBy("clip_id", "__key").orderBy(F.desc("named"), "clean_track_id")
    claims = claims.withColumn("__turn", F.row_number().over(of_key))
    met = signed.join(claims, ["clip_id", "__key"], "full")
    # a key's first claim, or the key itself without claims, brings its raw track in
    named = F.coalesce("named", F.lit(True))
    claimed = F.col("clean_track_id").isNotNull()
    brings = (F.coalesce("__n_raw", F.lit(0)) > 0) & F.coalesce(F.col("__turn") == 1, F.lit(True))
    nobody = F.lit(None).cast("string")

    def event(side: str, clean: Column, is_named: Column, member: Column) -> Column:
        n = F.nullif(f"__n{side}", F.lit(0))
        return F.struct(
            F.col(f"__a{side}").alias("__a"), F.col(f"__b{side}").alias("__b"), n.alias("__n"),
            clean.alias("clean_track_id"), is_named.alias("named"), member.alias("member"),
        )

    key, clean = F.col("__key"), F.col("clean_track_id")
    told = F.array(
        F.when(claimed & named, event("_raw", clean, F.lit(True), F.when(brings, key))),
        F.when(claimed & ~named, event("_clean", clean, F.lit(False), nobody)),
        F.when(brings & ~(claimed & named), event("_raw", nobody, F.lit(True), key)),
    )
    return met.select("clip_id", F.inline(F.array_compact(told)))


def candidate_groups(raw_boxes: DataFrame, prefix: str = "player_") -> DataFrame:
    """Raw tracks of every signature group, one row per member."""
    return trajectory_signatures(
        raw_boxes.filter(F.col("track_id").startswith(prefix))
    ).select("clip_id", F.col("signature").alias("candidate_group"), F.col("track_id").alias("raw_track_id"))


def match_ball(clean_tracks: DataFrame, clean_boxes: DataFrame, raw_boxes: DataFrame) -> DataFrame:
    """Match each clip's clean ball to a raw track; no claims are involved."""
    clips = raw_boxes.select("clip_id").union(clean_tracks.select("clip_id")).distinct()
    ball = clean_tracks.filter("track_id = 'ball'").select("clip_id", "source_track_id")
    raw_signatures = trajectory_signatures(raw_boxes)
    named = ball.join(
        raw_signatures.select("clip_id", F.col("track_id").alias("source_track_id"), F.col("track_id").alias("named_raw")),
        ["clip_id", "source_track_id"],
        "left",
    ).select("clip_id", "named_raw", F.lit(True).alias("__ball"))
    clean_signature = trajectory_signatures(clean_boxes.filter("track_id = 'ball'")).select(
        "clip_id", "signature"
    )
    same = (
        raw_signatures.filter(F.col("track_id").startswith("ball_"))
        .join(clean_signature, ["clip_id", "signature"])
        .groupBy("clip_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("track_id").alias("first_raw"))
    )
    joined = (
        clips.join(named, "clip_id", "left").join(same, "clip_id", "left")
    )
    count = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("__ball").isNull(), "missing_clean_ball")
        .when(F.col("named_raw").isNotNull() | (count == 1), "matched")
        .when(count == 0, "unmatched")
        .otherwise("ambiguous")
    )
    method = F.when(F.col("__ball").isNull(), F.lit(None)).otherwise(
        F.when(F.col("named_raw").isNotNull(), "source_track_id").otherwise("trajectory_signature")
    )
    raw_id = F.when(
        F.col("__ball"), F.coalesce("named_raw", F.when(count == 1, F.col("first_raw")))
    )
    return joined.select(
        "clip_id", status.alias("status"), method.alias("method"), raw_id.alias("raw_track_id"),
        F.when(F.col("named_raw").isNotNull(), F.lit(1).cast("bigint"))
        .otherwise(count.cast("bigint")).alias("candidate_count"),
    )


def selection_audit(raw_tracks: DataFrame, clean_tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """Every raw player with its clean track, or flagged as not selected."""
    taken = matches.filter("status = 'matched'").select(
        "clip_id", "clean_track_id", F.col("raw_track_id").alias("track_id")
    )
    details = clean_tracks.select(
        "clip_id", F.col("track_id").alias("clean_track_id"),
        "player_name", "jersey_number", "jersey_color",
    )
    players = raw_tracks.filter(F.col("track_id").startswith("player_")).select(*TRACK).distinct()
    joined = players.join(taken, TRACK, "left").join(details, ["clip_id", "clean_track_id"], "left")
    number = F.coalesce(F.nullif("jersey_number", F.lit("")), F.lit("?"))
    color = F.coalesce(F.nullif("jersey_color", F.lit("")), F.lit("unknown color"))
    text = F.when(
        F.col("clean_track_id").isNotNull(),
        F.concat(F.lit("#"), number, F.lit(" "), color, F.lit(" | "), "track_id"),
    ).otherwise(F.concat("track_id", F.lit(" | not selected")))
    return joined.select(
        "clip_id",
        F.col("track_id").alias("raw_track_id"),
        F.col("clean_track_id").isNotNull().alias("accepted"),
        "clean_track_id",
        "player_name",
        "jersey_number",
        "jersey_color",
        text.alias("text"),
    )


def selection_summary(audit: DataFrame) -> DataFrame:
    """Per clip counts and id lists of selected and unselected raw players."""
    pick = F.when(F.col("accepted"), F.col("raw_track_id"))
    skip = F.when(~F.col("accepted"), F.col("raw_track_id"))
    return audit.groupBy("clip_id").agg(
        F.array_sort(F.collect_set(pick)).alias("selected_raw_tracks"),
        F.array_sort(F.collect_set(skip)).alias("raw_player_tracks_not_selected"),
    )


def project_boxes(
    frames: DataFrame,
    tracks: DataFrame,
    boxes: DataFrame,
    scale_x: float,
    scale_y: float,
    out_of_range: str = "null",
    box_format: str = "xywh",
    corners: bool = True,
) -> DataFrame:
    """Boxes at the kept frames of each clip, scaled, with a validity flag.

    ``frames`` has ``clip_id, out_index, frame``; ``tracks`` has the length
    ``n_frames``. A frame beyond the track is clamped into it (training form)
    or left empty (inference form). Empty boxes are zeros with ``valid`` 0.
    """
    if out_of_range not in ("clamp", "null"):
        raise ValueError("out_of_range must be 'clamp' or 'null'")
    wanted = frames.join(tracks.select(*TRACK, "n_frames"), "clip_id")
    source = F.col("frame")
    if out_of_range == "clamp":
        source = F.greatest(F.lit(0), F.least(source, F.col("n_frames") - 1))
    wanted = wanted.select(*TRACK, "out_index", source.cast("int").alias("frame"))
    found = wanted.join(
        boxes.select(*TRACK, F.col("frame").cast("int").alias("frame"), "x", "y", "w", "h"),
        [*TRACK, "frame"],
        "left",
    )
    x, y, w, h = (F.col(c) for c in "xywh")
    if box_format == "xyxy":
        w, h = w - x, h - y
    present = F.col("x").isNotNull() & F.col("y").isNotNull()
    present = present & F.col("w").isNotNull() & F.col("h").isNotNull()
    box = scaled(x, y, w, h, scale_x, scale_y, corners)
    return found.select(
        *TRACK,
        "out_index",
        *[F.when(present, box[f"b{i}"]).otherwise(0.0).alias(f"b{i}") for i in range(4)],
        present.cast("double").alias("valid"),
    )


def bbox_at_time(
    times: DataFrame, references: DataFrame, boxes: DataFrame, window_length: float
) -> DataFrame:
    """Best box of each event at each instant, over all its track references.

    ``times`` has ``event_id, t``; ``references`` has ``event_id, ref_pos,
    window_id, track_id, window_start, window_end, n_frames``. Among windows
    containing the instant (both ends included) the one farther from its edges
    wins, the earlier reference on a tie. Instants without a box are kept.
    """
    best = _best_boxes(times, references, boxes, window_length)
    instants = times.select("event_id", "t").distinct()
    return instants.hint("merge").join(best, ["event_id", "t"], "left").select("event_id", "t", "best.*")


def _best_boxes(times: DataFrame, references: DataFrame, boxes: DataFrame, window_length: float) -> DataFrame:
    """The instants that have a box, each with its ``best`` one."""
    usable = references.filter("window_end > window_start AND n_frames > 0")
    hits = interval_join(
        times, usable, ["event_id"], "t", "window_start", "window_end", window_length, True
    )
    position = (F.col("t") - F.col("window_start")) / (F.col("window_end") - F.col("window_start"))
    frame = F.floor(position * F.col("n_frames"))
    hits = hits.withColumn(
        "frame", F.greatest(F.lit(0), F.least(F.col("n_frames") - 1, frame)).cast("int")
    ).withColumn(
        "margin",
        F.least(F.col("t") - F.col("window_start"), F.col("window_end") - F.col("t")),
    )
    valid = boxes.filter(is_box(F.col("w"), F.col("h"))).select(
        F.col("clip_id").alias("window_id"), "track_id",
        F.col("frame").cast("int").alias("frame"), "x", "y", "w", "h",
    )
    found = hits.join(valid, ["window_id", "track_id", "frame"]).withColumn(
        "reference", F.concat("window_id", F.lit("/"), "track_id")
    )
    return found.groupBy("event_id", "t").agg(
        F.max_by(
            F.struct("reference", "frame", "x", "y", "w", "h"),
            F.struct(F.col("margin"), -F.col("ref_pos")),
        ).alias("best")
    )


def time_grid(materials: DataFrame, fps: float) -> DataFrame:
    """One row per delivered frame of each material, with its source time."""
    count = F.rint((F.col("end_seconds") - F.col("start_seconds")) * fps).cast("bigint")
    return (
        materials.withColumn("__n", count)
        .filter("__n > 0")
        .select(
            "material_id",
            "event_id",
            "start_seconds",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("frame_index"),
        )
        .withColumn("t", F.col("start_seconds") + F.col("frame_index") / F.lit(float(fps)))
    )


def actor_coverage(
    materials: DataFrame, references: DataFrame, boxes: DataFrame, fps: float, window_length: float
) -> DataFrame:
    """Frames of each material and how many of them show the actor's box.

    The grid is far larger than the materials it is estimated from, so it is never broadcast.
    """
    grid = time_grid(materials, fps)
    shown = _best_boxes(grid, references, boxes, window_length).filter("best.reference IS NOT NULL")
    flagged = grid.hint("merge").join(
        shown.select("event_id", "t", F.lit(1).alias("__hit")), ["event_id", "t"], "left"
    )
    counted = flagged.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.count("__hit").alias("actor_bbox_frame_count")
    )
    return materials.select("material_id").join(counted, "material_id", "left").select(
        "material_id",
        F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
        F.coalesce("actor_bbox_frame_count", F.lit(0)).alias("actor_bbox_frame_count"),
    )
