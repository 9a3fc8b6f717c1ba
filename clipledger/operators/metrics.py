"""Sequence, set, ranking and interval metrics over many samples at once.

``references`` and ``predictions`` have ``sample_id, pos, actor, event``
(``actor`` NULL or empty when unknown); other key columns such as ``game`` come
from ``samples``.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.functions.numbers import interval_overlap, ratio
from clipledger.functions.text import event_name, known_event, report_event_name
from clipledger.operators.guards import stop_unless
from clipledger.operators.prefix import with_position
from clipledger.operators.timeline import TIME_BUCKET
from clipledger.vocabulary import EVENT_LABELS


def _actor() -> Column:
    return F.nullif("actor", F.lit(""))


def _label_grid(df: DataFrame, *keys: str) -> DataFrame:
    """Each distinct key with all ten labels, so absent labels count as zero."""
    labels = F.explode(F.array(*[F.lit(name) for name in EVENT_LABELS])).alias("event")
    if not keys:
        return df.sparkSession.range(1).select(labels)
    return df.select(*keys).distinct().select(*keys, labels)


def _alignment(predicted: list, reference: list) -> list[tuple[int, int]]:
    """Longest common subsequence as index pairs; None never equals anything.

    A prediction takes the next equal reference if that one is up, or if the
    length would drop without the prediction; else it goes unpaired. Each table
    row is kept as the bit set of positions where the length grows (the last
    reference is bit 0), so a row costs one pass over machine words.
    """
    size = len(reference)
    full = (1 << size) - 1
    where: dict = {}
    for j, key in enumerate(reversed(reference)):
        if key is not None:
            where[key] = where.get(key, 0) | (1 << j)
    state, rows = full, [0]
    for key in reversed(predicted):
        hit = state & where.get(key, 0)
        state = ((state + hit) | (state - hit)) & full
        rows.append(~state & full)
    rows.reverse()  # rows[i]: growth positions for predicted[i:] against the reference
    pairs, left = [], full  # left: the references that are still to come
    for i, key in enumerate(predicted):
        equal = where.get(key, 0) & left
        if not equal:
            continue
        spot = equal.bit_length()
        if spot == left.bit_length() or (rows[i] & left).bit_count() > (rows[i + 1] & left).bit_count():
            pairs.append((i, size - spot))
            left = (1 << (spot - 1)) - 1
    return pairs


_INDICES = T.ArrayType(T.IntegerType())
_PAIRS = T.StructType(
    [T.StructField(n, _INDICES) for n in ("type_pred", "type_ref", "full_pred", "full_ref")]
)


@F.pandas_udf(_PAIRS)
def _align(
    pred_events: pd.Series, pred_actors: pd.Series, ref_events: pd.Series, ref_actors: pd.Series
) -> pd.DataFrame:
    """Both alignments of each sample: by event, and by event and actor."""
    rows = []
    for pe, pa, re, ra in zip(pred_events, pred_actors, ref_events, ref_actors):
        by_type = _alignment(list(pe), list(re))
        by_both = _alignment(
            [(e, a) if a else None for e, a in zip(pe, pa)],
            [(e, a) if a else None for e, a in zip(re, ra)],
        )
        rows.append([[pair[k] for pair in pairs] for pairs in (by_type, by_both) for k in (0, 1)])
    return pd.DataFrame(rows, columns=_PAIRS.names)


def lcs_pairs(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """Order-preserving one-to-one alignment per sample, as (position) pairs.

    A prediction whose event no reference of its sample has never pairs and
    changes no length, so it is dropped by a semi join. References all stay: one
    that nothing equals still decides which prediction is skipped first. A sample
    is one short clip: both sides become arrays of one row, and Python aligns
    whole Arrow batches of samples.
    """
    cols = ["sample_id", "pos", "event", _actor().alias("actor")]
    key = ["sample_id", "event"]
    left = predictions.select(*cols).join(references.select(*key), key, "left_semi")
    right = references.select(*cols).join(predictions.select("sample_id"), "sample_id", "left_semi")
    both = left.select(*left.columns, F.lit(True).alias("predicted")).unionByName(
        right.select(*right.columns, F.lit(False).alias("predicted"))
    )
    row = F.struct("pos", "event", "actor")
    sides = both.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("predicted"), row))).alias("p"),
        F.array_sort(F.collect_list(F.when(~F.col("predicted"), row))).alias("r"),
    )
    aligned = sides.withColumn("a", _align("p.event", "p.actor", "r.event", "r.actor"))
    pairs = aligned.select(
        "sample_id",
        "p",
        "r",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.arrays_zip(F.col(f"a.{kind}_pred").alias("i"), F.col(f"a.{kind}_ref").alias("j")).alias("ij"),
                    )
                    for kind in ("type", "full")
                ]
            )
        ).alias("k"),
    ).select("sample_id", "p", "r", "k.kind", F.explode("k.ij").alias("ij"))
    pred, ref = F.get("p", F.col("ij.i")), F.get("r", F.col("ij.j"))
    return pairs.select(
        "sample_id",
        "kind",
        pred["pos"].alias("pred_pos"),
        ref["pos"].alias("ref_pos"),
        F.coalesce(pred["actor"] == ref["actor"], F.lit(False)).alias("same_actor"),
    )


def _prf(prefix: str, matches: Column, predicted: Column, reference: Column) -> list[Column]:
    return [
        matches.alias(f"{prefix}_matches"),
        ratio(matches, predicted).alias(f"{prefix}_precision"),
        ratio(matches, reference).alias(f"{prefix}_recall"),
        ratio(2 * matches, predicted + reference).alias(f"{prefix}_f1"),
    ]


def sequence_metrics(
    samples: DataFrame, references: DataFrame, predictions: DataFrame, by: str | None = None
) -> DataFrame:
    """Micro precision, recall and F1 for events and events with actor.

    With ``by`` (a column of ``samples``) there is one row per value and one
    overall row with NULL; otherwise one overall row.
    """
    pairs = lcs_pairs(references, predictions).groupBy("sample_id").agg(
        F.count_if(F.col("kind") == "type").alias("t"),
        F.count_if(F.col("kind") == "full").alias("f"),
        F.count_if((F.col("kind") == "type") & F.col("same_actor")).alias("a"),
    )
    sizes = predictions.select("sample_id", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        references.select("sample_id", F.lit(0).alias("p"), F.lit(1).alias("r"))
    ).groupBy("sample_id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    joined = samples.join(sizes, "sample_id", "left").join(pairs, "sample_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in "tfapr"]
    if by:
        totals = joined.groupingSets([[by], []], by).agg(*sums)
    else:
        totals = joined.agg(*sums)
    t, f, a, p, r = (F.col(c) for c in "tfapr")
    return totals.select(
        *([by] if by else []),
        p.alias("predicted"),
        r.alias("reference"),
        *_prf("type", t, p, r),
        *_prf("full", f, p, r),
        ratio(a, t).alias("participant_accuracy"),
        t.alias("participant_accuracy_denominator"),
    )


def pair_counts(
    samples: DataFrame, references: DataFrame, predictions: DataFrame, by: str | None = None
) -> DataFrame:
    """Matches, predicted and reference counts per event of (actor, event) sets.

    Both sides meet in one aggregate per (sample, actor, event). Unknown actors
    cannot match and are counted row by row.
    """
    keys = [by] if by else []
    real = F.col("event") != "blank"

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(real).select(
            "sample_id",
            _actor().alias("actor"),
            "event",
            *[F.lit(int(name == n)).alias(n) for n in ("ref", "pred")],
        )

    both = side(references, "ref").unionByName(side(predictions, "pred"))
    both = both.join(samples.select("sample_id", *keys), "sample_id")
    known = (
        both.filter("actor IS NOT NULL")
        .groupBy(*keys, "sample_id", "actor", "event")
        .agg(F.max("ref").alias("ref"), F.max("pred").alias("pred"))
        .groupBy(*keys, "event")
        .agg(
            F.sum(F.col("ref") * F.col("pred")).alias("matches"),
            F.sum("pred").alias("predicted"),
            F.sum("ref").alias("reference"),
        )
    )
    unknown = (
        both.filter("actor IS NULL")
        .groupBy(*keys, "event")
        .agg(
            F.lit(0).cast("bigint").alias("matches"),
            F.sum("pred").alias("predicted"),
            F.sum("ref").alias("reference"),
        )
    )
    grid = _label_grid(samples, *keys) if keys else _label_grid(samples)
    counts = known.unionByName(unknown).groupBy(*keys, "event").agg(
        *[F.sum(c).alias(c) for c in ("matches", "predicted", "reference")]
    )
    return grid.join(counts, [*keys, "event"], "left").na.fill(
        0, ["matches", "predicted", "reference"]
    )


def with_scores(counts: DataFrame) -> DataFrame:
    m, p, r = F.col("matches"), F.col("predicted"), F.col("reference")
    return counts.select(
        "*",
        ratio(m, p).alias("precision"),
        ratio(m, r).alias("recall"),
        ratio(2 * m, p + r).alias("f1"),
    )


def macro_scores(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Macro F1 over the ten fixed labels and over the supported ones."""
    supported = F.col("reference") > 0
    grouped = with_scores(counts).groupBy(*([by] if by else []))
    return grouped.agg(
        (F.sum("f1") / len(EVENT_LABELS)).alias("macro_f1_fixed_10"),
        ratio(F.sum(F.when(supported, F.col("f1")).otherwise(0.0)), F.count_if(supported)).alias(
            "macro_f1_gt_supported"
        ),
        F.array_join(F.array_sort(F.collect_set(F.when(~supported, F.col("event")))), ",").alias(
            "unsupported_classes"
        ),
    )


def overall_and_by(counts: DataFrame, by: str) -> DataFrame:
    """Per-group counts plus the overall counts under NULL, before any macro."""
    return counts.groupingSets([[by, "event"], ["event"]], by, "event").agg(
        *[F.sum(c).alias(c) for c in ("matches", "predicted", "reference")]
    )


def recall_at_k(
    samples: DataFrame, references: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)
) -> DataFrame:
    """Macro recall of (actor, event) pairs among the top ranked of each sample.

    All pairs are ranked by confidence (earlier position first on a tie) and
    cut before background is dropped. NULL when a sample has no ranking at all;
    ``samples`` then carries ``has_ranking`` false.
    """
    order = Window.partitionBy("sample_id").orderBy(F.desc("confidence"), "pos")
    top = (
        ranked.select("sample_id", "pos", _actor().alias("actor"), "event", "confidence")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(ks))
        .filter("actor IS NOT NULL AND event <> 'blank'")
        .groupBy("sample_id", "actor", "event")
        .agg(F.min("rank").alias("rank"))
    )
    wanted = references.filter("event <> 'blank'").select(
        "sample_id", _actor().alias("actor"), "event"
    )
    truth = wanted.filter("actor IS NOT NULL").distinct().unionByName(
        wanted.filter("actor IS NULL")
    ).join(samples.select("sample_id"), "sample_id", "left_semi")
    joined = truth.join(top, ["sample_id", "actor", "event"], "left")
    per_label = joined.groupBy("event").agg(
        F.count(F.lit(1)).alias("reference"),
        *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in ks],
    )
    grid = _label_grid(samples).join(per_label, "event", "left")
    macro = grid.agg(
        *[
            (F.sum(ratio(F.col(f"found_{k}"), F.col("reference"))) / len(EVENT_LABELS)).alias(
                f"recall_at_{k}"
            )
            for k in ks
        ]
    )
    if "has_ranking" not in samples.columns:
        return macro
    available = samples.agg(F.min(F.col("has_ranking").cast("int")).alias("available"))
    stacked = macro.unionByName(available, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in [*macro.columns, "available"]]
    )
    return stacked.select(
        *[F.when(F.col("available") == 1, F.col(c)).alias(c) for c in macro.columns]
    )


def temporal_overlaps(targets: DataFrame) -> DataFrame:
    """Overlap and class agreement of each target with its predicted range.

    ``targets`` has ``ref_event, ref_start, ref_end, pred_event, pred_start,
    pred_end``; the prediction is NULL when it is missing.
    """
    args = [F.col(c) for c in ("pred_start", "pred_end", "ref_start", "ref_end")]
    present = F.col("pred_event").isNotNull()
    return targets.select(
        "*",
        F.when(present, interval_overlap(*args, over_shorter=True)).otherwise(0.0).alias("miou"),
        F.when(present, interval_overlap(*args)).otherwise(0.0).alias("iou"),
        F.coalesce(F.col("pred_event") == F.col("ref_event"), F.lit(False)).alias("class_correct"),
    )


def temporal_hits(targets: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """Share of targets with the right class and overlap strictly above a threshold."""
    rows = temporal_overlaps(targets)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("target_count"),
        *[
            ratio(F.count_if(F.col("class_correct") & (F.col("miou") > t)), n).alias(
                "hit_at_" + str(t).replace(".", "_")
            )
            for t in thresholds
        ],
    )


def product_predictions(events: DataFrame, identities: DataFrame) -> DataFrame:
    """Evaluable predictions of the timeline, in order of their midpoint.

    The actor is only known when it is identified with colour and number. A bad
    range or an unknown label stops the query.
    """
    joined = events.select(
        "source_video_id", "event_id", event_name(F.col("event")).alias("event"), "confidence",
        F.col("evidence_start_seconds").alias("start"), F.col("evidence_end_seconds").alias("end"),
    ).filter("event <> 'blank'").join(
        identities.select("event_id", "status", "jersey_color", "jersey_number"), "event_id", "left"
    )
    known = (F.col("status") == "identified") & F.col("jersey_color").isNotNull()
    known = known & F.col("jersey_number").isNotNull()
    actor = F.when(known, F.concat_ws("#", F.lower(F.trim("jersey_color")), "jersey_number"))
    infinite = F.lit(float("inf"))
    good = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") < infinite)
    start = F.when(F.coalesce(good, F.lit(False)), F.col("start")).otherwise(
        F.raise_error(F.concat(F.lit("invalid event range: "), "event_id")).cast("double")
    )
    shaped = joined.select(
        "source_video_id",
        "event_id",
        "event",
        actor.alias("actor"),
        start.alias("interval_start"),
        F.col("end").alias("interval_end"),
        "confidence",
        F.coalesce("status", F.lit("missing")).alias("identity_status"),
    ).withColumn("midpoint", (F.col("interval_start") + F.col("interval_end")) / 2)
    return with_position(
        shaped,
        ["source_video_id"],
        [F.col("midpoint"), F.col("event_id")],
        F.floor(F.col("midpoint") / TIME_BUCKET),
        name="pos",
    )


def annotation_problems(
    manifest: DataFrame, annotations: DataFrame, events: DataFrame, allow_draft: bool = False
) -> DataFrame:
    """Everything that makes annotations unfit for scoring; empty when fine."""
    ids = manifest.select("sample_id").distinct()
    extra = annotations.select("sample_id").join(ids, "sample_id", "left_anti").select(
        F.lit("sample_not_in_manifest").alias("problem"), "sample_id"
    )
    missing = ids.join(annotations.select("sample_id"), "sample_id", "left_anti").select(
        F.lit("sample_without_annotation").alias("problem"), "sample_id"
    )
    repeated = annotations.groupBy("sample_id").count().filter("count > 1").select(
        F.lit("duplicate_annotation").alias("problem"), "sample_id"
    )
    label = known_event(F.col("event"))
    bad = label.isNull() | (label == "blank") | _actor().isNull()
    wrong = events.filter(bad).select(F.lit("invalid_event").alias("problem"), "sample_id").distinct()
    result = extra.unionByName(missing).unionByName(repeated).unionByName(wrong)
    if not allow_draft:
        reviewed = F.coalesce("reviewed", F.lit(False)) & (
            F.coalesce(F.trim("reviewer"), F.lit("")) != ""
        )
        draft = annotations.filter(~reviewed).select(
            F.lit("not_reviewed").alias("problem"), "sample_id"
        ).distinct()
        result = result.unionByName(draft)
    return result


def score_bundle(
    manifest: DataFrame,
    references: DataFrame,
    runs: DataFrame,
    predictions: DataFrame,
    silver: bool = False,
) -> dict[str, DataFrame]:
    """Scores over the whole manifest, overall and per game.

    ``manifest`` has ``sample_id, game``; ``runs`` has ``sample_id, status``. A
    sample that failed or never ran keeps its references and predicts nothing.
    ``silver`` leaves the order-based scores out.
    """
    state = manifest.select("sample_id", "game").join(
        runs.select("sample_id", "status"), "sample_id", "left"
    ).withColumn("status", F.coalesce("status", F.lit("not_run")))
    finished = state.filter(F.col("status").isin("completed", "completed_with_warnings"))
    counted = predictions.join(finished.select("sample_id"), "sample_id", "left_semi")
    samples = manifest.select("sample_id", "game")
    pairs = pair_counts(samples, references, counted, by="game")
    both = overall_and_by(pairs, "game")
    result = {
        "run_statuses": state.groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "identity_statuses": counted.groupBy("identity_status").agg(F.count(F.lit(1)).alias("n")),
        "failed_or_missing": state.join(finished.select("sample_id"), "sample_id", "left_anti"),
        "per_class": with_scores(both),
        "macro": macro_scores(both, by="game"),
    }
    if not silver:
        result["sequence"] = sequence_metrics(samples, references, counted, by="game")
    return result


def score_tracks(samples: DataFrame, references: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Model-level scores against reviewed track labels.

    ``predictions`` is one row per (sample, player) with ``event,
    class_probabilities, gate`` (struct start_time, end_time) and
    ``has_required``; a row without the required fields stops the query.
    References with an interval are timed against the player's gate.
    """
    complete = stop_unless(
        predictions, F.col("has_required"), F.concat(F.lit("prediction lacks probabilities or gate: "), "sample_id")
    )
    shaped = complete.select(
        "sample_id",
        F.col("player_id").alias("actor"),
        "pos",
        event_name(F.col("event")).alias("event"),
        "class_probabilities",
        "gate",
    )
    truth = references.withColumn("event", event_name(F.col("event")))
    ranked = shaped.select(
        "sample_id", "actor", "pos", F.posexplode(F.map_entries("class_probabilities")).alias("i", "e")
    ).select(
        "sample_id",
        "actor",
        F.struct("pos", "i").alias("pos"),
        event_name(F.col("e.key")).alias("event"),
        F.col("e.value").alias("confidence"),
    ).filter("event <> 'blank'")
    counts = pair_counts(samples, truth, shaped)
    timed = truth.filter("interval_start IS NOT NULL").join(
        # a player's last row counts
        shaped.groupBy("sample_id", "actor")
        .agg(F.max_by(F.struct("event", "gate"), "pos").alias("__last"))
        .select("sample_id", "actor", F.col("__last.event").alias("pred_event"), F.col("__last.gate").alias("gate"), F.lit(True).alias("__row")),
        ["sample_id", "actor"],
        "left",
    )
    lacking = F.col("__row") & F.col("gate").isNull()
    targets = timed.select(
        "sample_id",
        "actor",
        F.col("event").alias("ref_event"),
        F.col("interval_start").alias("ref_start"),
        F.col("interval_end").alias("ref_end"),
        F.when(F.coalesce(lacking, F.lit(False)), F.raise_error(F.lit("track without gate evidence")).cast("string"))
        .otherwise(F.col("pred_event"))
        .alias("pred_event"),
        F.col("gate.start_time").alias("pred_start"),
        F.col("gate.end_time").alias("pred_end"),
    )
    return {
        "per_class": with_scores(counts),
        "macro": macro_scores(counts),
        "recall": recall_at_k(samples, truth, ranked),
        "hits": temporal_hits(targets),
    }


def compare_expected(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted against expected label of chosen tracks.

    ``expected`` has ``clip_id, player_id, expected_event``; the first
    prediction of a player counts.
    """
    first = predictions.groupBy("clip_id", "player_id").agg(
        F.min_by(F.struct("event", "confidence"), "pos").alias("p")
    )
    joined = expected.withColumn(
        "expected_event", report_event_name(F.col("expected_event"))
    ).join(first, ["clip_id", "player_id"], "left")
    return joined.select(
        *expected.columns,
        F.when(F.col("p").isNull(), "missing_player_prediction").otherwise("completed").alias("status"),
        F.col("p.event").alias("actual_event"),
        F.col("p.confidence").alias("confidence"),
        F.coalesce(F.col("p.event") == F.col("expected_event"), F.lit(False)).alias("matched"),
    )
