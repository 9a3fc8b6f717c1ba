"""Turning model scores into predictions, evidence and losses."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.numbers import argmax, bootstrap_cross_entropy, softmax
from clipledger.vocabulary import LABELS

PERSON = ["video_id", "person_id"]


def _label_names() -> Column:
    return F.array(*[F.lit(name) for name in LABELS])


def _label_of(label_id: Column) -> Column:
    return F.coalesce(F.get(_label_names(), label_id), label_id.cast("string"))


def player_predictions(persons: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Label, confidence and full probability map of every valid person.

    ``persons`` has ``video_id, person_id, logits, valid``; ``tracks`` adds
    identity columns by (video, person).
    """
    scored = persons.filter("valid").select(*PERSON, softmax(F.col("logits")).alias("p"))
    scored = scored.withColumn("label_id", argmax(F.col("p")))
    names = F.transform(
        F.sequence(F.lit(0), F.size("p") - 1), lambda i: _label_of(i)
    )
    out = scored.select(
        *PERSON,
        "label_id",
        _label_of(F.col("label_id")).alias("event"),
        F.get("p", F.col("label_id")).alias("confidence"),
        F.map_from_arrays(names, F.col("p")).alias("class_probabilities"),
    )
    return out if tracks is None else out.join(tracks, PERSON, "left")


def gate_segment(clips: DataFrame, videos: DataFrame) -> DataFrame:
    """Clip with the highest gate of each person, as a time range.

    One partial aggregate: the maximum of (gate, earlier clip first) carries
    the frames along. ``videos`` gives ``fps`` and ``total_frames``.
    """
    usable = clips.filter(F.col("valid") & F.col("gate").isNotNull())
    best = usable.groupBy(*PERSON).agg(
        F.max_by(
            F.struct(
                "clip_index",
                "gate",
                F.array_min("frames").alias("first"),
                F.array_max("frames").alias("last"),
            ),
            F.struct(F.col("gate"), -F.col("clip_index")),
        ).alias("best")
    )
    return best.join(videos.select("video_id", "fps", "total_frames"), "video_id").select(
        *PERSON,
        F.col("best.clip_index").alias("clip_index"),
        F.col("best.gate").alias("gate_weight"),
        (F.col("best.first") / F.col("fps")).alias("start_time"),
        (F.least(F.col("best.last") + 1, F.col("total_frames")) / F.col("fps")).alias("end_time"),
    )


def temporal_evidence(
    predictions: DataFrame, clips: DataFrame, videos: DataFrame, topk: int = 2
) -> DataFrame:
    """The ``topk`` best clips of every non-background person, as time ranges.

    The rank filter is a constant, so Spark trims each group before the shuffle.
    """
    if topk < 1:
        raise ValueError("topk must be at least 1")
    wanted = predictions.filter("label_id <> 0").select(
        *PERSON, "label_id", "event", "confidence"
    )
    joined = clips.filter("valid").join(wanted, PERSON)
    probability = F.get(softmax(F.col("logits")), F.col("label_id"))
    scored = joined.select(
        *PERSON,
        "label_id",
        "event",
        "confidence",
        "clip_index",
        F.col("gate").alias("gate_weight"),
        probability.alias("clip_probability"),
        (F.coalesce("gate", F.lit(1.0)) * probability).alias("temporal_score"),
        F.array_min("frames").alias("start_frame"),
        (F.array_max("frames") + 1).alias("__end"),
    )
    order = Window.partitionBy(*PERSON).orderBy(F.desc("temporal_score"), "clip_index")
    kept = scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= topk)
    end = F.least(F.col("__end"), F.col("total_frames"))
    return (
        kept.join(videos.select("video_id", "fps", "total_frames"), "video_id")
        .withColumn("end_frame", end)
        .withColumn("start_time", F.col("start_frame") / F.col("fps"))
        .withColumn("end_time", F.col("end_frame") / F.col("fps"))
        .drop("__rank", "__end", "fps", "total_frames")
    )


def _dimension_means(weight: Column, vector: str, size: int) -> list[Column]:
    total = F.sum(weight)
    return [F.sum(weight * F.get(vector, F.lit(i))) / total for i in range(size)]


def gated_pool(clips: DataFrame, size: int) -> DataFrame:
    """Softmax-gated mean of the clip vectors of each person.

    Invalid clips have no weight; a person without a valid clip uses clip 0.
    The vectors are summed per dimension with partial aggregation, so they are
    never gathered; ``size`` is the vector length.
    """
    state = clips.groupBy(*PERSON).agg(
        F.max(F.when(F.col("valid"), F.col("gate"))).alias("__top")
    )
    joined = clips.join(state, PERSON)
    weight = F.when(
        F.col("__top").isNotNull(),
        F.when(F.col("valid"), F.exp(F.col("gate") - F.col("__top"))).otherwise(0.0),
    ).otherwise(F.when(F.col("clip_index") == 0, 1.0).otherwise(0.0))
    weighted = joined.select(*PERSON, "features", weight.alias("__w")).filter("__w > 0")
    pooled = weighted.groupBy(*PERSON).agg(
        F.array(*_dimension_means(F.col("__w"), "features", size)).alias("pooled")
    )
    return pooled


def gate_weights(clips: DataFrame) -> DataFrame:
    """The normalised gate weight of every clip (companion of ``gated_pool``)."""
    top = clips.groupBy(*PERSON).agg(F.max(F.when(F.col("valid"), F.col("gate"))).alias("__top"))
    raw = F.when(
        F.col("__top").isNotNull(),
        F.when(F.col("valid"), F.exp(F.col("gate") - F.col("__top"))).otherwise(0.0),
    ).otherwise(F.when(F.col("clip_index") == 0, 1.0).otherwise(0.0))
    weighted = clips.join(top, PERSON).withColumn("__w", raw)
    total = weighted.groupBy(*PERSON).agg(F.sum("__w").alias("__total"))
    return weighted.join(total, PERSON).select(
        *PERSON, "clip_index", (F.col("__w") / F.col("__total")).alias("weight")
    )


def topk_pool(clips: DataFrame, size: int, k: int = 2) -> DataFrame:
    """Mean of the ``k`` best-scored clip vectors of each person.

    Invalid clips score -10000, so they only fill up when too few are valid.
    """
    score = F.when(F.col("valid"), F.col("score")).otherwise(F.lit(-1e4))
    order = Window.partitionBy(*PERSON).orderBy(F.desc("__score"), "clip_index")
    best = (
        clips.select(*PERSON, "clip_index", "features", score.alias("__score"))
        .withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= max(1, int(k)))
    )
    return best.groupBy(*PERSON).agg(
        F.array(*_dimension_means(F.lit(1.0), "features", size)).alias("pooled"),
        F.count(F.lit(1)).alias("clips_used"),
    )


def noisy_label_filter(
    persons: DataFrame, threshold: float = 0.8, blank: int = 0
) -> DataFrame:
    """Flag background-labelled rows whose prediction is confidently an event."""
    p = softmax(F.col("logits"))
    confident = (F.array_max(p) > threshold) & (argmax(p) != blank)
    return persons.withColumn("included", ~((F.col("label") == blank) & confident))


def bootstrap_ce(
    persons: DataFrame,
    clips: DataFrame,
    class_weight: list[float],
    smoothing: float = 0.1,
    alpha: float = 0.8,
    threshold: float = 0.8,
    clip_weight: float = 0.2,
    tau: float = 0.5,
    blank: int = 0,
) -> DataFrame:
    """Per video the person, clip and total loss, as an evaluation metric.

    ``persons`` has ``video_id, person_id, logits, label``; ``clips`` has
    ``video_id, person_id, clip_index, logits``. A video whose persons are all
    filtered out has NULL person and total loss.
    """
    classes = len(class_weight)
    weights = F.array(*[F.lit(float(w)) for w in class_weight])
    flagged = noisy_label_filter(persons, threshold, blank)
    person_loss = bootstrap_cross_entropy(
        F.col("logits"), F.col("label"), classes, smoothing, alpha
    ) * F.get(weights, F.col("label"))
    by_person = flagged.groupBy("video_id").agg(
        F.avg(F.when(F.col("included"), person_loss)).alias("person_loss")
    )

    labelled = clips.join(persons.select(*PERSON, "label"), PERSON)
    positive = F.col("label") != blank
    loss = bootstrap_cross_entropy(
        F.col("logits"), F.col("label"), classes, smoothing, alpha
    ) * F.get(weights, F.col("label"))
    scored = labelled.select(
        *PERSON,
        positive.alias("positive"),
        loss.alias("loss"),
        F.get(softmax(F.col("logits")), F.col("label")).alias("truth"),
    )
    # Clip weights are a softmax of truth / tau. The truth is a probability, so
    # subtracting its upper bound 1 keeps the powers finite without a first pass.
    power = F.exp((F.col("truth") - 1.0) / tau)
    per_person = scored.groupBy(*PERSON, "positive").agg(
        (F.sum(power * F.col("loss")) / F.sum(power)).alias("weighted"),
        F.sum("loss").alias("plain"),
        F.count(F.lit(1)).alias("n"),
    )
    by_clip = per_person.groupBy("video_id").agg(
        F.avg(F.when(F.col("positive"), F.col("weighted"))).alias("pos"),
        (
            F.sum(F.when(~F.col("positive"), F.col("plain")))
            / F.sum(F.when(~F.col("positive"), F.col("n")))
        ).alias("neg"),
    )
    clip_loss = F.coalesce(
        (F.col("pos") + F.col("neg")) / 2, F.col("pos"), F.col("neg"), F.lit(0.0)
    )
    return (
        by_person.join(by_clip, "video_id", "left")
        .select("video_id", "person_loss", clip_loss.alias("clip_loss"))
        .withColumn("total_loss", F.col("person_loss") + clip_weight * F.col("clip_loss"))
    )
