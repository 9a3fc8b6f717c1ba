"""Queries on model scores."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.numbers import smooth_one_hot
from clipledger.operators import scores as sc
from clipledger.plans.registry import query
from clipledger.plans.views import Views
from clipledger.vocabulary import LABELS

_NAMES = "[" + ",".join(f"'{n}'" for n in LABELS) + "]"
_TOP = "list_position(p, list_max(p))"


@query(
    "player_predictions",
    f"""SELECT video_id, person_id, CAST({_TOP} - 1 AS INTEGER) AS label_id, {_NAMES}[{_TOP}] AS event,
      round(list_max(p), 6) AS confidence, round(p[1], 6) AS p_blank, round(p[11], 6) AS p_ast FROM person_probabilities WHERE valid""",
)
def player_predictions_query(v: Views) -> DataFrame:
    p = F.col("class_probabilities")
    return sc.player_predictions(v.persons).select(
        "video_id", "person_id", "label_id", "event",
        F.round("confidence", 6).alias("confidence"),
        F.round(p["blank"], 6).alias("p_blank"),
        F.round(p["ast"], 6).alias("p_ast"),
    )


@query(
    "gate_segment",
    """SELECT video_id, person_id, clip_index, gate AS gate_weight, clip_index*10/CAST(10 AS DOUBLE) AS start_time,
      least(clip_index*10 + 20, 505)/CAST(10 AS DOUBLE) AS end_time FROM (SELECT *, row_number() OVER
      (PARTITION BY video_id, person_id ORDER BY gate DESC, clip_index) AS r FROM clips WHERE valid) WHERE r = 1""",
)
def gate_segment_query(v: Views) -> DataFrame:
    return sc.gate_segment(v.clips, v.score_videos)


@query(
    "temporal_evidence",
    f"""WITH w AS (SELECT video_id, person_id, CAST({_TOP} - 1 AS INTEGER) AS label_id, {_NAMES}[{_TOP}] AS event FROM person_probabilities WHERE valid),
    s AS (SELECT c.video_id, c.person_id, label_id, event, clip_index, c.p[label_id + 1] AS clip_probability, gate*c.p[label_id + 1] AS score
      FROM clip_probabilities c JOIN w ON w.video_id = c.video_id AND w.person_id = c.person_id WHERE valid AND label_id <> 0)
    SELECT video_id, person_id, label_id, event, clip_index, round(clip_probability, 6) AS clip_probability, round(score, 6) AS temporal_score,
      clip_index*10 AS start_frame, CAST(least(clip_index*10 + 20, 505) AS INTEGER) AS end_frame, clip_index*10/CAST(10 AS DOUBLE) AS start_time,
      least(clip_index*10 + 20, 505)/CAST(10 AS DOUBLE) AS end_time
    FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person_id ORDER BY score DESC, clip_index) AS r FROM s) WHERE r <= 2""",
)
def temporal_evidence_query(v: Views) -> DataFrame:
    found = sc.temporal_evidence(sc.player_predictions(v.persons), v.clips, v.score_videos, topk=2)
    return found.select(
        "video_id", "person_id", "label_id", "event", "clip_index",
        F.round("clip_probability", 6).alias("clip_probability"),
        F.round("temporal_score", 6).alias("temporal_score"),
        "start_frame", "end_frame", "start_time", "end_time",
    )


_WEIGHT = """WITH t AS (SELECT *, max(CASE WHEN valid THEN gate END) OVER (PARTITION BY video_id, person_id) AS top FROM clips),
    w AS (SELECT *, CASE WHEN top IS NULL THEN CASE WHEN clip_index = 0 THEN 1 ELSE 0 END WHEN valid THEN exp(gate - top) ELSE 0 END AS wt FROM t)"""


@query(
    "gated_pool",
    _WEIGHT + """ SELECT video_id, person_id, """ + ", ".join(
        f"round(sum(wt*features[{i + 1}])/sum(wt), 6) AS f{i}" for i in range(64)
    ) + " FROM w GROUP BY 1, 2 HAVING sum(wt) > 0",
)
def gated_pool_query(v: Views) -> DataFrame:
    return sc.gated_pool(v.clips, 64).select(
        "video_id", "person_id", *[F.round(F.col("pooled")[i], 6).alias(f"f{i}") for i in range(64)]
    )


@query(
    "gate_weights",
    _WEIGHT + """ SELECT video_id, person_id, clip_index, round(wt/sum(wt) OVER (PARTITION BY video_id, person_id), 6) AS weight FROM w
    QUALIFY sum(wt) OVER (PARTITION BY video_id, person_id) > 0""",
)
def gate_weights_query(v: Views) -> DataFrame:
    # A person whose clips are all invalid and lack clip 0 has no weights.
    usable = v.clips.groupBy("video_id", "person_id").agg(
        F.max(F.col("valid") | (F.col("clip_index") == 0)).alias("ok")
    ).filter("ok")
    weights = sc.gate_weights(v.clips.join(usable.drop("ok"), ["video_id", "person_id"], "left_semi"))
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "topk_pool",
    """SELECT video_id, person_id, count(*) AS clips_used, """ + ", ".join(f"round(avg(features[{i + 1}]), 6) AS f{i}" for i in range(64)) + """
    FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person_id ORDER BY CASE WHEN valid THEN gate ELSE -10000 END DESC, clip_index) AS r FROM clips)
    WHERE r <= 2 GROUP BY 1, 2""",
)
def topk_pool_query(v: Views) -> DataFrame:
    return sc.topk_pool(v.clips, 64, 2).select(
        "video_id", "person_id", "clips_used",
        *[F.round(F.col("pooled")[i], 6).alias(f"f{i}") for i in range(64)],
    )


@query(
    "noisy_label_filter",
    f"""SELECT video_id, person_id, CAST(label AS INTEGER) AS label, NOT (label = 0 AND list_max(p) > 0.3 AND {_TOP} <> 1) AS included FROM person_probabilities""",
)
def noisy_label_query(v: Views) -> DataFrame:
    return sc.noisy_label_filter(v.persons, 0.3).select("video_id", "person_id", "label", "included")


_CE = """-list_sum(list_transform(p, lambda q, i: (0.8*(0.1/11 + CASE WHEN i = label + 1 THEN 0.9 ELSE 0 END) + 0.2*q)*ln(q)))"""


@query(
    "bootstrap_ce",
    f"""WITH pl AS (SELECT video_id, label, {_CE}*CASE WHEN label = 0 THEN 0.1 ELSE 1 END AS loss,
        NOT (label = 0 AND list_max(p) > 0.3 AND {_TOP} <> 1) AS included FROM person_probabilities),
    a AS (SELECT video_id, avg(CASE WHEN included THEN loss END) AS person_loss FROM pl GROUP BY 1),
    cl AS (SELECT c.video_id, c.person_id, q.label, c.p FROM clip_probabilities c JOIN persons q ON q.video_id = c.video_id AND q.person_id = c.person_id),
    cs AS (SELECT video_id, person_id, label, p[label + 1] AS truth, {_CE}*CASE WHEN label = 0 THEN 0.1 ELSE 1 END AS loss FROM cl),
    pp AS (SELECT video_id, person_id, label, sum(exp(truth/0.5)*loss)/sum(exp(truth/0.5)) AS weighted, sum(loss) AS plain, count(*) AS n FROM cs GROUP BY 1, 2, 3),
    b AS (SELECT video_id, avg(CASE WHEN label <> 0 THEN weighted END) AS pos,
        sum(CASE WHEN label = 0 THEN plain END)/sum(CASE WHEN label = 0 THEN n END) AS neg FROM pp GROUP BY 1)
    SELECT video_id, round(person_loss, 6) AS person_loss, round(coalesce((pos + neg)/2, pos, neg, 0), 6) AS clip_loss,
      round(person_loss + 0.2*coalesce((pos + neg)/2, pos, neg, 0), 6) AS total_loss FROM a JOIN b USING (video_id)""",
)
def bootstrap_ce_query(v: Views) -> DataFrame:
    losses = sc.bootstrap_ce(v.persons, v.clips.drop("label"), [0.1] + [1.0] * 10, threshold=0.3)
    return losses.select(
        "video_id", *[F.round(c, 6).alias(c) for c in ("person_loss", "clip_loss", "total_loss")]
    )


@query(
    "smooth_one_hot",
    """SELECT vec_id, array_to_string(list_transform(range(0, 11), lambda i: CASE WHEN i = label THEN '0.909091' ELSE '0.009091' END), ',') AS target FROM embeddings""",
)
def smooth_one_hot_query(v: Views) -> DataFrame:
    target = F.transform(smooth_one_hot(F.col("label"), 11, 0.1), lambda x: F.format_number(x, 6))
    return v.table("embeddings").select("vec_id", F.array_join(target, ",").alias("target"))
