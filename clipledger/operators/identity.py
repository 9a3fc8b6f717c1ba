"""Conservative identity resolution: conflicts stay visible, tracks never vanish."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.text import (
    identifier,
    normalize_color,
    normalize_jersey_number,
    parse_track_reference,
    strip,
)
from clipledger.operators.prefix import running, with_previous

# Texts stored with a decision.
REASONS = {
    "identified": "every complete observation supports one colour and number",
    "conflicting": "several jersey identities were seen on one track",
    "anonymous": "no complete and consistent jersey identity was seen",
}

CANDIDATE = ["jersey_color", "jersey_number"]


def _complete() -> Column:
    return F.coalesce(F.col("is_on_court_player"), F.lit(False)) & (
        F.col("jersey_color").isNotNull() & F.col("jersey_number").isNotNull()
    )


def identity_candidates(observations: DataFrame, key: str = "track_ref") -> DataFrame:
    """Support per (colour, number) of each track, with the supporting frames.

    Aggregates partially; frames are in arrival order. ``pos`` gives arrival.
    """
    return (
        observations.filter(_complete())
        .groupBy(key, *CANDIDATE)
        .agg(
            F.count(F.lit(1)).alias("support_count"),
            F.sum("confidence").alias("confidence_sum"),
            F.array_sort(F.collect_list(F.struct("pos", "frame_index"))).getField("frame_index").alias("frames"),
        )
    )


def roster_names(roster: DataFrame) -> DataFrame:
    """The name of each (game, colour, number) that has exactly one roster row."""
    keyed = roster.select(
        "game",
        F.lower(strip(F.col("color"))).alias("jersey_color"),
        strip(F.col("jersey")).alias("jersey_number"),
        strip(F.col("name")).alias("name"),
    ).filter("jersey_color <> '' AND jersey_number <> '' AND name <> ''")
    return keyed.groupBy("game", *CANDIDATE).agg(
        F.when(F.count(F.lit(1)) == 1, F.min("name")).alias("player_name")
    )


def resolve_identity(
    tracks: DataFrame, observations: DataFrame, roster: DataFrame | None = None, key: str = "track_ref"
) -> DataFrame:
    """Identified, conflicting or anonymous, for every row of ``tracks``.

    ``tracks`` has ``key, game, clip_id, track_id``. One identity is supported
    when the smallest and the largest (colour, number) pair agree, so a single
    partial aggregate per track decides everything; nothing is collected.
    """
    pair = F.when(_complete(), F.struct(*CANDIDATE))
    color = F.when(F.coalesce("is_on_court_player", F.lit(False)), F.col("jersey_color"))
    evidence = observations.groupBy(key).agg(
        F.min(pair).alias("lo"),
        F.max(pair).alias("hi"),
        F.min(color).alias("lo_color"),
        F.max(color).alias("hi_color"),
        F.count(F.lit(1)).alias("observation_count"),
    )
    joined = tracks.join(evidence, key, "left")
    status = (
        F.when(F.col("lo").isNull(), "anonymous")
        .when(F.col("lo") == F.col("hi"), "identified")
        .otherwise("conflicting")
    )
    known = F.col("status") == "identified"
    joined = joined.withColumn("status", status)
    decided = joined.select(
        *tracks.columns,
        "status",
        F.when(
            known,
            F.concat_ws(
                ":",
                identifier(F.col("game")),
                F.lit("jersey"),
                identifier(F.col("lo.jersey_color")),
                identifier(F.col("lo.jersey_number")),
            ),
        )
        .otherwise(
            F.concat_ws(
                ":",
                identifier(F.col("game")),
                F.lit("clip"),
                identifier(F.col("clip_id")),
                F.lit("track"),
                identifier(F.col("track_id")),
            )
        )
        .alias("participant_id"),
        F.when(known, F.col("lo.jersey_color"))
        .otherwise(F.when(F.col("lo_color") == F.col("hi_color"), F.col("lo_color")))
        .alias("jersey_color"),
        F.when(known, F.col("lo.jersey_number")).alias("jersey_number"),
        F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        _reason(F.col("status")).alias("reason"),
    )
    if roster is None:
        return decided.withColumn("player_name", F.lit(None).cast("string"))
    names = roster_names(roster).filter("player_name IS NOT NULL").select(
        "game",
        F.col("jersey_color").alias("__c"),
        F.col("jersey_number").alias("__n"),
        "player_name",
    )
    # A decision's colour is compared in the roster's normal form.
    return (
        decided.withColumn("__c", F.lower(strip(F.col("jersey_color"))))
        .withColumn("__n", strip(F.col("jersey_number")))
        .join(names, ["game", "__c", "__n"], "left")
        .drop("__c", "__n")
    )


def _reason(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in REASONS.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def decision_candidates(decisions: DataFrame, candidates: DataFrame, key: str = "track_ref") -> DataFrame:
    """Nest the candidates into their decisions, best supported first."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("support_count")).alias("a"),
                (-F.col("confidence_sum")).alias("b"),
                F.struct(*CANDIDATE, "support_count", "confidence_sum", "frames").alias("item"),
            )
        )
    )
    nested = candidates.groupBy(key).agg(ordered.getField("item").alias("candidates"))
    return decisions.join(nested, key, "left")


def roster_candidates(roster: DataFrame) -> DataFrame:
    """The sorted names of each (game, colour, number), how many, and the only one."""
    names = (
        roster.select(
            "game",
            normalize_color(F.col("color")).alias("jersey_color"),
            normalize_jersey_number(F.col("jersey")).alias("jersey_number"),
            strip(F.col("name")).alias("name"),
        )
        .filter("jersey_color IS NOT NULL AND jersey_number IS NOT NULL AND name <> ''")
        .groupBy("game", *CANDIDATE)
        .agg(F.array_sort(F.collect_set("name")).alias("candidate_names"))
    )
    count = F.size("candidate_names")
    return names.select(
        "*", count.alias("candidates"), F.when(count == 1, F.get("candidate_names", F.lit(0))).alias("player_name")
    )


def find_candidates(identities: DataFrame, candidates: DataFrame, join: str = "merge") -> DataFrame:
    """Lookup status and candidates for each (game, colour, number) row.

    ``candidates`` comes from ``roster_candidates``; a form that its names should have for every
    row is made there once, not for each row. Rows of one identity repeat its names. ``join``
    ("merge" or "shuffle_hash", which sorts no rows) keeps them together, so that files hold each list once.
    """
    shaped = identities.withColumn("jersey_color", normalize_color(F.col("jersey_color"))).withColumn(
        "jersey_number", normalize_jersey_number(F.col("jersey_number"))
    )
    joined = shaped.join(candidates.hint(join), ["game", *CANDIDATE], "left")
    missing_color = F.col("jersey_color").isNull()
    missing_number = F.col("jersey_number").isNull()
    absent, several = F.col("candidates").isNull(), F.col("candidates") > 1
    status = (
        F.when(missing_color | missing_number, "invalid_identity")
        .when(absent, "no_match")
        .when(several, "ambiguous")
        .otherwise("matched")
    )
    reason = (
        F.when(missing_color, "color_missing")
        .when(missing_number, "number_missing")
        .when(absent, "not_in_roster")
        .when(several, "several_in_roster")
    )
    return joined.select(
        *shaped.columns, status.alias("lookup_status"), "player_name", "candidate_names", reason.alias("lookup_reason")
    )


def roster_lookup(identities: DataFrame, roster: DataFrame) -> DataFrame:
    """Lookup status and candidate names for each (game, colour, number) row."""
    found = find_candidates(identities, roster_candidates(roster))
    return found.withColumn("candidate_names", F.coalesce("candidate_names", F.array().cast("array<string>")))


def aggregate_observations(
    observations: DataFrame,
    tracks: DataFrame,
    min_confidence: float = 0.6,
    key: str = "track_ref",
    bucket_frames: int = 4096,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Track status, identity candidates and run-length segments over frames.

    ``observations`` has ``key, frame_index, pos, status, jersey_color,
    jersey_number, number_confidence``. Consecutive evidence with the same
    identity forms a segment; NULL colours are equal to each other.
    """
    usable = observations.filter(
        (F.col("status") == "valid")
        & (F.col("number_confidence") >= min_confidence)
        & F.col("jersey_number").isNotNull()
    ).select(key, "frame_index", "pos", *CANDIDATE, F.col("number_confidence").alias("confidence"))

    candidates = usable.groupBy(key, *CANDIDATE).agg(
        F.count(F.lit(1)).alias("support_count"),
        F.round(F.sum("confidence"), 4).alias("confidence_sum"),
        F.array_sort(F.collect_list("frame_index")).alias("frames"),
    )

    order = ["frame_index", "pos"]
    bucket = F.expr(f"frame_index div {bucket_frames}")
    stepped = with_previous(usable, [key], order, bucket, CANDIDATE)
    same = F.col("previous").isNotNull() & F.col("jersey_color").eqNullSafe(
        F.col("previous.jersey_color")
    ) & F.col("jersey_number").eqNullSafe(F.col("previous.jersey_number"))
    opening = F.when(~same, F.struct(*order))
    runs = running(
        stepped, [key], [F.col(c) for c in order], bucket, {"__run": ("max", opening, True)}
    )
    segments = runs.groupBy(key, "__run", *CANDIDATE).agg(
        F.min("frame_index").alias("start_frame"),
        F.max("frame_index").alias("end_frame"),
        F.array_sort(F.collect_list("frame_index")).alias("observation_frames"),
    ).drop("__run")

    pair = F.when(
        F.col("__ok"), F.struct(F.coalesce("jersey_color", F.lit("")).alias("c"), "jersey_number")
    )
    ok = (
        (F.col("status") == "valid")
        & (F.col("number_confidence") >= min_confidence)
        & F.col("jersey_number").isNotNull()
    )
    summary = (
        observations.withColumn("__ok", F.coalesce(ok, F.lit(False)))
        .groupBy(key)
        .agg(
            F.min(pair).alias("lo"),
            F.max(pair).alias("hi"),
            F.count_if("__ok").alias("valid_evidence_count"),
            F.count_if(F.col("status") == "model_output_inconsistency").alias(
                "model_output_inconsistency_count"
            ),
        )
    )
    joined = tracks.select(key).join(summary, key, "left")
    zero = F.lit(0).cast("bigint")
    status = (
        F.when(F.col("lo").isNotNull() & (F.col("lo") != F.col("hi")), "mixed_identity")
        .when(F.col("lo").isNotNull(), "stable_identity")
        .when(F.coalesce("model_output_inconsistency_count", zero) > 0, "model_output_inconsistency")
        .otherwise("unresolved")
    )
    stable = F.col("lo") == F.col("hi")
    result = joined.select(
        key,
        status.alias("status"),
        F.when(stable, F.nullif(F.col("lo.c"), F.lit(""))).alias("jersey_color"),
        F.when(stable, F.col("lo.jersey_number")).alias("jersey_number"),
        F.coalesce("valid_evidence_count", zero).alias("valid_evidence_count"),
        F.coalesce("model_output_inconsistency_count", zero).alias(
            "model_output_inconsistency_count"
        ),
    )
    return result, candidates, segments


def event_references(events: DataFrame) -> DataFrame:
    """Track references of each event, one row each, in order, split in parts."""
    exploded = events.select(
        "event_id", "event", "source_video_id", F.posexplode("track_references").alias("ref_pos", "track_ref")
    )
    parts = F.coalesce(
        parse_track_reference(F.col("track_ref")),
        F.raise_error(F.concat(F.lit("bad track reference: "), "track_ref")).cast(
            "struct<window_id:string,track_id:string>"
        ),
    )
    return exploded.withColumn("parts", parts).select(
        "event_id", "event", "source_video_id", "ref_pos", "track_ref", "parts.window_id", "parts.track_id"
    )


def distinct_references(references: DataFrame) -> DataFrame:
    """Each (window, track) once: what an expensive observer has to look at."""
    return references.select("track_ref", "window_id", "track_id").distinct()


def event_actor_identity(
    events: DataFrame,
    evidence_status: DataFrame,
    observations: DataFrame,
    roster: DataFrame | None = None,
) -> DataFrame:
    """Identity of every event from the shared evidence of its tracks.

    ``evidence_status`` has one row per observed reference (``track_ref,
    status``), ``observations`` the frames seen on it. A reference without
    completed evidence is listed as failed.
    """
    references = event_references(events)
    status = references.join(evidence_status.select("track_ref", "status"), "track_ref", "left")
    failed = F.coalesce(F.col("status") != "completed", F.lit(True))
    per_event = status.groupBy("event_id").agg(
        F.count_if(failed).alias("failed_reference_count"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("ref_pos", "track_ref"))))
        .getField("track_ref")
        .alias("failed_track_references"),
    )
    rejoined = references.select("event_id", "ref_pos", "track_ref").join(observations, "track_ref")
    # Arrival order: by reference position, then by position inside the evidence.
    seen = rejoined.select(
        "event_id",
        F.struct("ref_pos", "pos").alias("pos"),
        "frame_index",
        "is_on_court_player",
        "jersey_color",
        "jersey_number",
        "confidence",
    )
    targets = events.select(
        "event_id",
        "event",
        F.col("source_video_id").alias("game"),
        F.col("event_id").alias("clip_id"),
        F.col("event_id").alias("track_id"),
        "track_references",
    )
    resolved = resolve_identity(targets, seen, roster, key="event_id")
    return (
        resolved.join(per_event, "event_id", "left")
        .withColumn("failed_reference_count", F.coalesce("failed_reference_count", F.lit(0)))
        .withColumnRenamed("game", "source_video_id")
    )


def identity_report(decisions: DataFrame, evidence_status: DataFrame) -> DataFrame:
    """Per video: events, distinct references and failed references."""
    references = decisions.select(
        "source_video_id", F.explode("track_references").alias("track_ref")
    ).distinct()
    failed = F.coalesce(F.col("status") != "completed", F.lit(True))
    by_reference = (
        references.join(evidence_status.select("track_ref", "status"), "track_ref", "left")
        .groupBy("source_video_id")
        .agg(
            F.count(F.lit(1)).alias("unique_track_reference_count"),
            F.count_if(failed).alias("failed_track_reference_count"),
        )
    )
    by_event = decisions.groupBy("source_video_id").agg(F.count(F.lit(1)).alias("event_count"))
    return by_event.join(by_reference, "source_video_id", "left").na.fill(0)


def reusable_evidence(
    references: DataFrame, cache: DataFrame, sample_count: int, pad_ratio: float
) -> tuple[DataFrame, DataFrame]:
    """Split references into cached ones and ones to observe again.

    Only completed rows made with the same sampling are reused.
    """
    fitting = cache.filter(
        (F.col("status") == "completed")
        & (F.col("sample_count") == sample_count)
        & (F.col("pad_ratio") == pad_ratio)
    )
    reused = fitting.join(references.select("track_ref"), "track_ref", "left_semi")
    pending = references.join(fitting.select("track_ref"), "track_ref", "left_anti")
    return reused, pending


def reusable_video_reports(reports: DataFrame, sample_count: int, pad_ratio: float) -> DataFrame:
    """Whole-video reports that may be reused: same sampling and nothing failed."""
    return reports.filter(
        F.col("status").isin("succeeded", "completed_with_warnings")
        & (F.col("sample_count") == sample_count)
        & (F.col("pad_ratio") == pad_ratio)
        & (F.coalesce("failed_track_reference_count", F.lit(0)) == 0)
    )


def associate_across_materials(resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Person references per material, and one profile per participant.

    ``resolutions`` has ``source_video_id, material_id, pos, track_id, status,
    jersey_color, jersey_number, participant_id, player_name``. Only identified
    rows with colour and number are shared between materials.
    """
    color = F.lower(strip(F.col("jersey_color")))
    number = strip(F.col("jersey_number"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("anonymous"))
    track = F.coalesce(F.nullif("track_id", F.lit("")), F.lit("unknown"))
    shaped = resolutions.select(
        "source_video_id",
        "material_id",
        "pos",
        track.alias("track_id"),
        status.alias("identity_status"),
        color.alias("jersey_color"),
        number.alias("jersey_number"),
        F.nullif(strip(F.col("participant_id")), F.lit("")).alias("__given"),
        "player_name",
    )
    shared = F.coalesce(
        (F.col("identity_status") == "identified")
        & (F.col("jersey_color") != "")
        & (F.col("jersey_number") != ""),
        F.lit(False),
    )
    video = identifier(F.col("source_video_id"))
    jersey_id = F.concat_ws(
        ":", video, F.lit("jersey"), identifier(F.col("jersey_color")), identifier(F.col("jersey_number"))
    )
    own_id = F.concat_ws(
        ":", video, F.lit("material"), identifier(F.col("material_id")), F.lit("track"), identifier(F.col("track_id"))
    )
    references = shaped.withColumn("__shared", shared).select(
        "source_video_id",
        "material_id",
        "pos",
        F.when(F.col("__shared"), F.coalesce("__given", jersey_id)).otherwise(own_id).alias("participant_id"),
        "track_id",
        "jersey_color",
        "jersey_number",
        "player_name",
        "identity_status",
        F.when(F.col("__shared"), "jersey_color_and_number")
        .otherwise("material_scoped_anonymous")
        .alias("association_method"),
    )
    first = F.struct("material_id", "pos")
    profiles = references.groupBy("source_video_id", "participant_id").agg(
        F.min_by(F.struct("player_name", "jersey_color", "jersey_number"), first).alias("head"),
        F.count(F.lit(1)).alias("appearance_count"),
        F.array_sort(F.collect_set("material_id")).alias("material_ids"),
    )
    profiles = profiles.select(
        "source_video_id",
        "participant_id",
        F.col("head.player_name").alias("display_name"),
        F.col("head.jersey_color").alias("jersey_color"),
        F.col("head.jersey_number").alias("jersey_number"),
        "appearance_count",
        "material_ids",
    )
    return references, profiles


def with_observer_errors(tracks: DataFrame, results: DataFrame, key: str = "track_ref") -> DataFrame:
    """Keep every track; one whose observer failed has no evidence and its error."""
    joined = tracks.join(results.select(key, "error", "observation_count"), key, "left")
    return joined.select(
        *tracks.columns,
        F.when(F.col("error").isNotNull(), 0)
        .otherwise(F.coalesce("observation_count", F.lit(0)))
        .cast("bigint")
        .alias("observation_count"),
        "error",
    )
