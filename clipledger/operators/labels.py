"""Ground-truth labels from recorded actions, with every anomaly kept.

Operators that can reject rows return ``(rows, anomalies)``; anomalies have
``scope_id, code, severity, message, context``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.text import collapse, lookup, normalize_color, normalize_jersey_number
from clipledger.session import cut_lineage
from clipledger.vocabulary import DIRECT_ACTIONS, SHOT_ACTIONS

ANOMALY = ["scope_id", "code", "severity", "message", "context"]
ACTOR = ["clip_id", "jersey_color", "jersey_number"]


def context(**values: Column) -> Column:
    """Text map with the details of an anomaly."""
    pairs = [item for k, v in values.items() for item in (F.lit(k), v.cast("string"))]
    if not pairs:
        return F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        )
    return F.create_map(*pairs)


def anomaly(code: str, severity: str, message: str, **details: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(message).alias("message"),
        context(**details).alias("context"),
    )


def anomaly_rows(df: DataFrame, scope: str, *found: Column) -> DataFrame:
    """Explode anomaly structs (NULL where a rule holds) into rows."""
    rows = df.select(F.col(scope).alias("scope_id"), F.explode(F.array(*found)).alias("a"))
    return rows.filter("a IS NOT NULL").select("scope_id", "a.*")


def map_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label contributions of every action, and the actions that map to none.

    ``actions`` has ``clip_id, action_index, player, color, action, result,
    assisted, other_player`` and optionally ``is_object``. One pass over the
    rows; an unknown action is an error, never background.
    """
    is_object = F.coalesce("is_object", F.lit(True)) if "is_object" in actions.columns else F.lit(True)
    shaped = actions.select(
        "clip_id",
        "action_index",
        "player",
        F.col("color").alias("raw_color"),
        "other_player",
        "result",
        F.coalesce("assisted", F.lit(False)).alias("assisted"),
        is_object.alias("is_object"),
        normalize_color(F.col("color")).alias("jersey_color"),
        normalize_jersey_number(F.col("player")).alias("number"),
        normalize_jersey_number(F.col("other_player")).alias("assistant"),
        collapse(F.coalesce("action", F.lit(""))).alias("action_name"),
    ).withColumn("key", F.lower("action_name"))
    shot = F.col("key").isin(SHOT_ACTIONS)
    known = F.col("is_object") & F.col("jersey_color").isNotNull() & F.col("number").isNotNull()
    label = F.when(
        shot,
        F.when(F.col("result"), "Made Shot").when(~F.col("result"), "Missed Shot"),
    ).otherwise(lookup(DIRECT_ACTIONS, F.col("key")))
    shaped = shaped.withColumn("known", known).withColumn(
        "label", F.when(known, label)
    ).withColumn("shot", shot)
    assisted = F.col("shot") & F.col("label").isNotNull() & F.col("assisted")

    def entry(number: Column, name: Column, role: str) -> Column:
        return F.struct(
            number.alias("jersey_number"), name.alias("label"), F.lit(role).alias("role")
        )

    primary = F.when(
        F.col("label").isNotNull(), entry(F.col("number"), F.col("label"), "primary_actor")
    )
    assist = F.when(
        assisted & F.col("assistant").isNotNull(),
        entry(F.col("assistant"), F.lit("ast"), "assistant"),
    )
    contributions = shaped.select(
        "clip_id",
        "jersey_color",
        F.col("action_index").alias("source_action_index"),
        F.explode(F.array(primary, assist)).alias("e"),
    ).filter("e IS NOT NULL").select(
        *ACTOR[:2], "e.jersey_number", "e.label", "source_action_index", "e.role"
    )
    index = F.col("action_index")
    anomalies = anomaly_rows(
        shaped,
        "clip_id",
        F.when(
            ~F.col("is_object"),
            anomaly("INVALID_ACTION", "error", "the action is not an object", source_action_index=index),
        ),
        F.when(
            F.col("is_object") & ~F.col("known"),
            anomaly(
                "INVALID_ACTION_IDENTITY", "error", "an actor needs a colour and a number",
                source_action_index=index, color=F.col("raw_color"), player=F.col("player"),
            ),
        ),
        F.when(
            F.col("known") & F.col("shot") & F.col("result").isNull(),
            anomaly("MISSING_SHOT_RESULT", "error", "a shot needs a boolean result", source_action_index=index),
        ),
        F.when(
            F.col("known") & ~F.col("shot") & F.col("label").isNull(),
            anomaly(
                "UNMAPPED_ACTION", "error", "the action has no label and is not background",
                source_action_index=index, action=F.col("action_name"),
            ),
        ),
        F.when(
            assisted & F.col("assistant").isNull(),
            anomaly(
                "MISSING_ASSISTANT_IDENTITY", "error", "an assisted shot needs the assistant's number",
                source_action_index=index, other_player=F.col("other_player"),
            ),
        ),
    )
    return contributions, anomalies


def check_documents(documents: DataFrame) -> DataFrame:
    """Anomalies of whole action documents.

    ``documents`` has ``clip_id, numerosity, action_count``; the count is NULL
    when the document holds no action list.
    """
    count, stated = F.col("action_count"), F.col("numerosity")
    return anomaly_rows(
        documents,
        "clip_id",
        F.when(
            count.isNull(),
            anomaly("INVALID_ACTION_DOCUMENT", "error", "the document has no action list"),
        ),
        F.when(
            stated.isNotNull() & (stated != count),
            anomaly(
                "NUMEROSITY_MISMATCH", "error", "stated and actual number of actions differ",
                numerosity=stated, action_count=count,
            ),
        ),
        F.when(
            count == 0, anomaly("NO_STRUCTURED_ACTION", "error", "at least one action is needed")
        ),
    )


def label_groups(contributions: DataFrame) -> DataFrame:
    """What each (clip, colour, number) was told: labels, their number, and the first contribution."""
    arrival = F.struct("source_action_index", (F.col("role") == "assistant").alias("late"))
    return contributions.groupBy(*ACTOR).agg(
        (F.min("label") != F.max("label")).alias("mixed"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.min_by(F.struct("label", "source_action_index", "role"), arrival).alias("first"),
    )


def collapse_labels(contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One label per (clip, colour, number); conflicting actors are removed.

    A partial aggregate: labels agree when the smallest equals the largest.
    """
    return _collapsed(label_groups(contributions))


def _collapsed(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = grouped.filter("NOT mixed").select(*ACTOR, "first.*")
    details = dict(
        jersey_color=F.col("jersey_color"),
        jersey_number=F.col("jersey_number"),
        contributions=F.col("n"),
    )
    anomalies = anomaly_rows(
        grouped,
        "clip_id",
        F.when(
            F.col("mixed"),
            anomaly(
                "MULTI_LABEL_ACTOR", "error", "one player has several labels in a clip",
                labels=F.array_join("labels", ","), **details,
            ),
        ),
        F.when(
            ~F.col("mixed") & (F.col("n") > 1),
            anomaly(
                "DUPLICATE_LABEL_COLLAPSED", "warning", "repeats of one label were collapsed",
                labels=F.array_join("labels", ","), **details,
            ),
        ),
    )
    return rows, anomalies


def map_documents(documents: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapsed labels and all mapping anomalies of complete documents.

    Both come from the groups of labels, which are written once.
    """
    contributions, action_anomalies = map_actions(actions)
    labels, label_anomalies = _collapsed(cut_lineage(label_groups(contributions)))
    anomalies = (
        check_documents(documents).unionByName(action_anomalies).unionByName(label_anomalies)
    )
    return labels, anomalies


def draft_events(actions: DataFrame) -> DataFrame:
    """Every mapped action as an event, without collapsing; actor is ``color#number``."""
    contributions, _ = map_actions(actions)
    return contributions.select(
        "clip_id",
        F.col("label").alias("event"),
        F.concat_ws("#", "jersey_color", "jersey_number").alias("actor"),
        "source_action_index",
        "role",
    )


def build_annotations(
    clips: DataFrame, labels: DataFrame, mapping_anomalies: DataFrame, tracks: DataFrame
) -> dict[str, DataFrame]:
    """Join labels to tracks by exact (colour, number) and decide on each clip.

    ``tracks`` has ``clip_id, track_id, is_object, n_frames, jersey_color,
    jersey_number``; the ball is the track named ``ball``. A clip is accepted
    when it has no error. Returns ``annotations`` (labelled and background
    players plus the ball), ``assignments``, ``anomalies`` and ``verdicts``.
    """
    shaped = tracks.join(clips.select("clip_id"), "clip_id", "left_semi").select(
        "clip_id",
        "track_id",
        F.coalesce("is_object", F.lit(True)).alias("is_object"),
        F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
        F.col("jersey_color").alias("raw_color"),
        F.col("jersey_number").alias("raw_number"),
        normalize_color(F.col("jersey_color")).alias("jersey_color"),
        normalize_jersey_number(F.col("jersey_number")).alias("jersey_number"),
    )
    # Labels and tracks feed several outputs and the verdict; both are small next
    # to the actions and boxes they come from and are written once.
    shaped, labels = cut_lineage(shaped), cut_lineage(labels)
    mapping_anomalies = cut_lineage(mapping_anomalies)
    players = shaped.filter("track_id <> 'ball'")
    usable = F.col("is_object") & (F.col("n_frames") > 0)
    named = F.col("jersey_color").isNotNull() & F.col("jersey_number").isNotNull()
    track = F.col("track_id")
    track_anomalies = anomaly_rows(
        players,
        "clip_id",
        F.when(
            ~F.col("is_object"),
            anomaly("INVALID_TRACK_PAYLOAD", "warning", "the track is not an object", track_id=track),
        ),
        F.when(
            F.col("is_object") & (F.col("n_frames") == 0),
            anomaly("MISSING_PLAYER_TRAJECTORY", "warning", "the track has no trajectory", track_id=track),
        ),
        F.when(
            usable & ~named,
            anomaly(
                "UNRESOLVED_TRACK_IDENTITY", "warning", "a track without identity is left out",
                track_id=track, jersey_color=F.col("raw_color"), jersey_number=F.col("raw_number"),
            ),
        ),
    )
    resolved = players.filter(usable & named).select(*ACTOR, "track_id")
    actors = resolved.groupBy(*ACTOR).agg(
        F.count(F.lit(1)).alias("tracks"), F.min("track_id").alias("only_track")
    )
    ambiguous = anomaly_rows(
        actors,
        "clip_id",
        F.when(
            F.col("tracks") > 1,
            anomaly(
                "AMBIGUOUS_TRACK_IDENTITY", "error", "several tracks share one identity",
                jersey_color=F.col("jersey_color"), jersey_number=F.col("jersey_number"),
                tracks=F.col("tracks"),
            ),
        ),
    )
    wanted = labels.join(clips.select("clip_id"), "clip_id", "left_semi").join(actors, ACTOR, "left")
    unmatched = anomaly_rows(
        wanted,
        "clip_id",
        F.when(
            F.col("tracks").isNull(),
            anomaly(
                "UNMATCHED_GT_ACTOR", "error", "no track has the actor's colour and number",
                jersey_color=F.col("jersey_color"), jersey_number=F.col("jersey_number"),
                label=F.col("label"), source_action_index=F.col("source_action_index"),
                role=F.col("role"),
            ),
        ),
    )
    assignments = wanted.filter("tracks = 1").select(
        "clip_id", F.col("only_track").alias("track_id"), "jersey_color", "jersey_number",
        "label", "source_action_index", "role",
    )
    balls = shaped.filter("track_id = 'ball' AND is_object AND n_frames > 0")
    no_ball = clips.select("clip_id").join(balls.select("clip_id"), "clip_id", "left_anti")
    ball_anomalies = anomaly_rows(
        no_ball,
        "clip_id",
        anomaly("MISSING_BALL_TRACK", "error", "a clip needs a ball trajectory"),
    )
    own = mapping_anomalies.join(
        clips.select(F.col("clip_id").alias("scope_id")), "scope_id", "left_semi"
    )
    anomalies = own
    for part in (track_anomalies, ambiguous, unmatched, ball_anomalies):
        anomalies = anomalies.unionByName(part)
    failed = anomalies.filter("severity = 'error'").select(
        F.col("scope_id").alias("clip_id")
    ).distinct()
    verdicts = clips.join(failed.withColumn("__bad", F.lit(True)), "clip_id", "left").select(
        *clips.columns,
        F.when(F.col("__bad"), "excluded").otherwise("accepted").alias("status"),
    )
    accepted = verdicts.filter("status = 'accepted'").select("clip_id")
    kept = resolved.join(
        assignments.select("clip_id", "track_id", "label"), ["clip_id", "track_id"], "left"
    ).unionByName(
        balls.select("clip_id", "track_id", "jersey_color", "jersey_number").withColumn(
            "label", F.lit(None).cast("string")
        )
    )
    return {
        "annotations": kept.join(accepted, "clip_id", "left_semi"),
        "assignments": assignments,
        "anomalies": anomalies,
        "verdicts": verdicts,
    }


def count_anomalies(anomalies: DataFrame) -> DataFrame:
    code = F.coalesce("code", F.lit("UNKNOWN_ANOMALY"))
    return anomalies.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def label_batch(
    clips: DataFrame,
    documents: DataFrame,
    actions: DataFrame,
    tracks: DataFrame,
    reports: DataFrame,
    overwrite: bool = False,
) -> dict[str, DataFrame]:
    """Label all clips that are not finished; excluded ones are tried again.

    ``clips`` has ``clip_id, has_action, has_tracks`` (and optionally
    ``read_error``), ``reports`` the earlier ``clip_id, status,
    has_annotation``. A clip with a missing input is excluded with the reason.
    """
    done = reports.filter("status = 'accepted' AND has_annotation").select("clip_id")
    todo = clips if overwrite else clips.join(done, "clip_id", "left_anti")
    skipped = clips.join(todo.select("clip_id"), "clip_id", "left_anti")
    error = F.col("read_error") if "read_error" in clips.columns else F.lit(None).cast("string")
    marked = todo.withColumn(
        "missing",
        F.when(~F.col("has_action"), "MISSING_ACTION_DOCUMENT")
        .when(~F.col("has_tracks"), "MISSING_CLEAN_TRACK")
        .when(error.isNotNull(), "PROCESSING_ERROR"),
    )
    incomplete = marked.filter("missing IS NOT NULL")
    missing = incomplete.select(
        F.col("clip_id").alias("scope_id"),
        F.col("missing").alias("code"),
        F.lit("error").alias("severity"),
        F.lit("an input of the clip is missing or unreadable").alias("message"),
        context().alias("context"),
    )
    ready = marked.filter("missing IS NULL").select("clip_id")
    # Labels and anomalies read the actions; they meet the clips once.
    labels, mapping = map_documents(
        documents.join(ready, "clip_id", "left_semi"),
        cut_lineage(actions.join(ready, "clip_id", "left_semi")),
    )
    built = build_annotations(ready, labels, mapping, tracks)
    verdicts = built["verdicts"].unionByName(
        incomplete.select("clip_id", F.lit("excluded").alias("status"))
    )
    stale = reports.filter("has_annotation").join(
        verdicts.filter("status = 'excluded'").select("clip_id"), "clip_id", "left_semi"
    )
    return {
        "annotations": built["annotations"],
        "anomalies": built["anomalies"].unionByName(missing),
        "verdicts": verdicts,
        "skipped": skipped,
        "stale_annotations": stale if overwrite else stale.filter(F.lit(False)),
    }


def batch_summary(batch: dict[str, DataFrame]) -> DataFrame:
    """Processed, accepted, excluded and skipped counts, one row."""
    counts = batch["verdicts"].agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "excluded").alias("excluded"),
    )
    skipped = batch["skipped"].agg(F.count(F.lit(1)).alias("skipped_existing_reports"))
    stacked = counts.unionByName(skipped, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
