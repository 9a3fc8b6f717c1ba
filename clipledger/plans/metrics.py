"""Queries on evaluation metrics, bundles and job state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.numbers import interval_overlap
from clipledger.operators import bundle as bd
from clipledger.operators import incremental as inc
from clipledger.operators import metrics as mt
from clipledger.plans.registry import query
from clipledger.plans.views import Views, text



def _lcs(pred: str, ref: str) -> str:
    """SQL for the longest common subsequence length: a fold over the predictions.

    The new row is the running maximum of (match ? left-above + 1 : above).
    """
    step = f"list_transform(range(1, len({ref}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN {ref}[k] = x.v THEN (CASE WHEN k > 1 THEN acc.l[k-1] ELSE 0 END) + 1 ELSE acc.l[k] END)))"
    start = f"{{'v': '', 'l': list_transform(range(1, len({ref}) + 1), lambda j: 0::BIGINT)}}"
    items = f"list_transform({pred}, lambda item: {{'v': item, 'l': []::BIGINT[]}})"
    return f"list_last(list_reduce({items}, lambda acc, x: {{'v': '', 'l': {step}}}, {start}).l)"


_LISTS = """WITH p AS (SELECT sample_id, game, list(event ORDER BY pos) AS pe, list(coalesce(event || '/' || actor, 'x' || pos) ORDER BY pos) AS pa FROM predicted GROUP BY 1, 2),
    r AS (SELECT sample_id, list(event ORDER BY pos) AS re, list(coalesce(event || '/' || actor, 'y' || pos) ORDER BY pos) AS ra FROM references_ GROUP BY 1),
    m AS (SELECT p.sample_id, game, len(pe) AS np, len(re) AS nr, """ + _lcs("pe", "re") + " AS t, " + _lcs("pa", "ra") + """ AS f
      FROM p JOIN r ON r.sample_id = p.sample_id),
    s AS (SELECT game, CAST(sum(np) AS BIGINT) AS predicted, CAST(sum(nr) AS BIGINT) AS reference, CAST(sum(t) AS BIGINT) AS t, CAST(sum(f) AS BIGINT) AS f FROM m GROUP BY GROUPING SETS ((game), ()))"""


def _d(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 9)"


@query(
    "sequence_metrics",
    _LISTS + f""" SELECT game, predicted, reference, t AS type_matches, f AS full_matches, {_d('t/predicted')} AS type_precision, {_d('t/reference')} AS type_recall,
      {_d('2*t/(predicted + reference)')} AS type_f1, {_d('2*f/(predicted + reference)')} AS full_f1 FROM s""",
)
def sequence_metrics_query(v: Views) -> DataFrame:
    out = mt.sequence_metrics(v.samples, v.references, v.predicted, by="game")
    return out.select(
        "game", "predicted", "reference", "type_matches", "full_matches",
        *[F.round(c, 9).alias(c) for c in ("type_precision", "type_recall", "type_f1", "full_f1")],
    )


@query("lcs_pair_counts", _LISTS + " SELECT sample_id, t AS type_pairs, f AS full_pairs FROM m WHERE t > 0")
def lcs_pairs_query(v: Views) -> DataFrame:
    return mt.lcs_pairs(v.references, v.predicted).groupBy("sample_id").agg(
        F.count_if(F.col("kind") == "type").alias("type_pairs"),
        F.count_if(F.col("kind") == "full").alias("full_pairs"),
    )


@query("participant_accuracy")
def participant_accuracy_query(v: Views) -> DataFrame:
    return mt.sequence_metrics(v.samples, v.references, v.predicted).select(
        "participant_accuracy", "participant_accuracy_denominator"
    )


_GRID = """g AS (SELECT game, l.event, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted,
      CAST(coalesce(reference, 0) AS BIGINT) AS reference FROM (SELECT DISTINCT game, e.event FROM evaluated, event_labels e) l LEFT JOIN pair_counts c USING (game, event)),
    b AS (SELECT game, event, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(reference) AS BIGINT) AS reference
      FROM g GROUP BY GROUPING SETS ((game, event), (event))),
    f AS (SELECT *, CASE WHEN predicted > 0 THEN matches/predicted ELSE 0 END AS p, CASE WHEN reference > 0 THEN matches/reference ELSE 0 END AS r,
      CASE WHEN predicted + reference > 0 THEN 2*matches/(predicted + reference) ELSE 0 END AS f1 FROM b)"""


def _pairs(v: Views) -> DataFrame:
    return mt.overall_and_by(mt.pair_counts(v.samples, v.references, v.predicted, by="game"), "game")


@query(
    "pair_metrics",
    f"WITH {_GRID} SELECT game, event, matches, predicted, reference, {_d('p')} AS precision, {_d('r')} AS recall, {_d('f1')} AS f1 FROM f",
)
def pair_metrics_query(v: Views) -> DataFrame:
    scored = mt.with_scores(_pairs(v))
    return scored.select(
        "game", "event", "matches", "predicted", "reference",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
    )


@query(
    "macro_scores",
    f"""WITH {_GRID} SELECT game, {_d('sum(f1)/10')} AS macro_f1_fixed_10, {_d('avg(CASE WHEN reference > 0 THEN f1 END)')} AS macro_f1_gt_supported,
      coalesce(string_agg(event, ',' ORDER BY event) FILTER (WHERE reference = 0), '') AS unsupported_classes FROM f GROUP BY game""",
)
def macro_scores_query(v: Views) -> DataFrame:
    macro = mt.macro_scores(_pairs(v), by="game")
    return macro.select(
        "game", *[F.round(c, 9).alias(c) for c in ("macro_f1_fixed_10", "macro_f1_gt_supported")], "unsupported_classes"
    )


@query(
    "recall_at_k",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, pos) AS k FROM predicted),
    t AS (SELECT DISTINCT sample_id, actor, event FROM references_ WHERE actor IS NOT NULL UNION ALL SELECT sample_id, NULL, event FROM references_ WHERE actor IS NULL),
    q AS (SELECT t.*, (SELECT min(k) FROM r WHERE r.sample_id = t.sample_id AND r.actor = t.actor AND r.event = t.event) AS k FROM t),
    c AS (SELECT event, count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE k <= {k}) AS f{k}" for k in (1, 3, 5)) + """ FROM q GROUP BY 1)
    SELECT """ + ", ".join(_d(f"sum(f{k}/n)/10") + f" AS recall_at_{k}" for k in (1, 3, 5)) + " FROM c",
)
def recall_at_k_query(v: Views) -> DataFrame:
    recall = mt.recall_at_k(v.samples.withColumn("has_ranking", F.lit(True)), v.references, v.predicted)
    return recall.select(*[F.round(c, 9).alias(c) for c in recall.columns])


_OVER = """(SELECT *, CASE WHEN pred_event IS NULL THEN 0 ELSE greatest(0, least(re, pe) - greatest(rs, ps)) END AS shared FROM targets)"""


@query(
    "temporal_hits",
    f"""SELECT count(*) AS target_count, {_d("count(*) FILTER (WHERE pred_event = ref_event AND shared/least(re - rs, pe - ps) > 0.3)/count(*)")} AS hit_at_0_3,
      {_d("count(*) FILTER (WHERE pred_event = ref_event AND shared/least(re - rs, pe - ps) > 0.5)/count(*)")} AS hit_at_0_5 FROM {_OVER}""",
)
def temporal_hits_query(v: Views) -> DataFrame:
    hits = mt.temporal_hits(v.targets)
    return hits.select("target_count", *[F.round(c, 9).alias(c) for c in ("hit_at_0_3", "hit_at_0_5")])


@query(
    "interval_overlap",
    f"""SELECT rs AS ref_start, ps AS pred_start, {_d('shared/(re - rs + pe - ps - shared)')} AS iou, {_d('shared/least(re - rs, pe - ps)')} AS over_shorter
    FROM {_OVER} WHERE pred_event IS NOT NULL""",
)
def interval_overlap_query(v: Views) -> DataFrame:
    args = [F.col(c) for c in ("pred_start", "pred_end", "ref_start", "ref_end")]
    return v.targets.filter("pred_event IS NOT NULL").select(
        "ref_start", "pred_start",
        F.round(interval_overlap(*args), 9).alias("iou"),
        F.round(interval_overlap(*args, over_shorter=True), 9).alias("over_shorter"),
    )


@query(
    "product_predictions",
    """SELECT video_id AS source_video_id, 'e' || event_id AS event_id, event,
      CASE WHEN value > 20 AND value < 120 THEN 'white#' || (CAST(floor(value) AS BIGINT) % 30) END AS actor, confidence, t + len/2 AS midpoint,
      CASE WHEN value <= 20 THEN 'missing' WHEN value < 150 THEN 'identified' ELSE 'conflicting' END AS identity_status,
      CAST(row_number() OVER (PARTITION BY video_id ORDER BY t + len/2, 'e' || event_id) - 1 AS BIGINT) AS pos
    FROM evidence WHERE event <> 'blank'""",
)
def product_predictions_query(v: Views) -> DataFrame:
    return mt.product_predictions(v.timed_events, v.product_identities).select(
        "source_video_id", "event_id", "event", "actor", "confidence", "midpoint", "identity_status", "pos"
    )




@query(
    "annotation_problems",
    """WITH s AS (SELECT sample_id, max(value) AS top FROM evaluated GROUP BY 1)
    SELECT 'sample_without_annotation' AS problem, sample_id FROM s WHERE top > 200 UNION ALL SELECT 'duplicate_annotation', sample_id FROM s WHERE top < 20
    UNION ALL SELECT 'not_reviewed', sample_id FROM s WHERE top BETWEEN 20 AND 30 UNION ALL SELECT DISTINCT 'invalid_event', sample_id FROM evaluated WHERE actor IS NULL""",
)
def annotation_problems_query(v: Views) -> DataFrame:
    tops = v._evaluated.groupBy("sample_id").agg(F.max("value").alias("top"))
    reviewed = tops.filter("top <= 200").select(
        "sample_id", (~F.col("top").between(20, 30)).alias("reviewed"), F.lit("ann").alias("reviewer")
    )
    twice = reviewed.unionByName(tops.filter("top < 20").select("sample_id", F.lit(True).alias("reviewed"), F.lit("bob").alias("reviewer")))
    return mt.annotation_problems(v.samples, twice, v.references)


def _runs(v: Views) -> DataFrame:
    tops = v._evaluated.groupBy("sample_id").agg(F.max("value").alias("top"))
    return tops.filter("top <= 300").select(
        "sample_id",
        F.when(F.col("top") < 30, "failed").when(F.col("top") < 60, "completed_with_warnings").otherwise("completed").alias("status"),
    )


def _bundle_scores(v: Views) -> dict[str, DataFrame]:
    predictions = v.predicted.withColumn("identity_status", F.when(F.col("actor").isNotNull(), "identified").otherwise("missing"))
    return mt.score_bundle(v.samples, v.references, _runs(v), predictions)


_BUNDLE = """WITH st AS (SELECT sample_id, any_value(game) AS game, CASE WHEN max(value) > 300 THEN 'not_run' WHEN max(value) < 30 THEN 'failed'
        WHEN max(value) < 60 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM evaluated GROUP BY 1),
    kept AS (SELECT * FROM predicted WHERE sample_id IN (SELECT sample_id FROM st WHERE status LIKE 'completed%'))"""


@query("bundle_statuses", _BUNDLE + " SELECT status, count(*) AS n FROM st GROUP BY 1")
def bundle_statuses_query(v: Views) -> DataFrame:
    return _bundle_scores(v)["run_statuses"]


@query(
    "bundle_per_class",
    _BUNDLE + """, u AS (SELECT game, sample_id, actor, event, 1 AS r, 0 AS p, CASE WHEN actor IS NULL THEN pos ELSE 0 END AS u FROM references_
        UNION ALL SELECT game, sample_id, actor, event, 0, 1, CASE WHEN actor IS NULL THEN -pos - 1 ELSE 0 END FROM kept WHERE event <> 'blank'),
    d AS (SELECT game, sample_id, actor, event, max(r) AS r, max(p) AS p FROM u GROUP BY game, sample_id, actor, event, u),
    l AS (SELECT DISTINCT v.game, e.event FROM evaluated v, event_labels e),
    c AS (SELECT l.game, l.event, coalesce(sum(r*p), 0) AS m, coalesce(sum(p), 0) AS p, coalesce(sum(r), 0) AS r FROM l LEFT JOIN d ON d.game = l.game AND d.event = l.event GROUP BY 1, 2)
    SELECT game, event, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(r) AS BIGINT) AS reference FROM c
    GROUP BY GROUPING SETS ((game, event), (event))""",
)
def bundle_per_class_query(v: Views) -> DataFrame:
    return _bundle_scores(v)["per_class"].select("game", "event", "matches", "predicted", "reference")


@query("bundle_failures", _BUNDLE + " SELECT sample_id, game, status FROM st WHERE status NOT LIKE 'completed%'")
def bundle_failures_query(v: Views) -> DataFrame:
    return _bundle_scores(v)["failed_or_missing"].select("sample_id", "game", "status")


@query(
    "bundle_identity_statuses",
    _BUNDLE + " SELECT CASE WHEN actor IS NOT NULL THEN 'identified' ELSE 'missing' END AS identity_status, count(*) AS n FROM kept GROUP BY 1",
)
def bundle_identity_statuses_query(v: Views) -> DataFrame:
    return _bundle_scores(v)["identity_statuses"]


@query(
    "bundle_macro",
    _BUNDLE + """, u AS (SELECT game, sample_id, actor, event, 1 AS r, 0 AS p, CASE WHEN actor IS NULL THEN pos ELSE 0 END AS u FROM references_
        UNION ALL SELECT game, sample_id, actor, event, 0, 1, CASE WHEN actor IS NULL THEN -pos - 1 ELSE 0 END FROM kept WHERE event <> 'blank'),
    d AS (SELECT game, sample_id, actor, event, max(r) AS r, max(p) AS p FROM u GROUP BY game, sample_id, actor, event, u),
    l AS (SELECT DISTINCT v.game, e.event FROM evaluated v, event_labels e),
    c AS (SELECT l.game, l.event, coalesce(sum(r*p), 0) AS m, coalesce(sum(p), 0) AS p, coalesce(sum(r), 0) AS r FROM l LEFT JOIN d ON d.game = l.game AND d.event = l.event GROUP BY 1, 2),
    b AS (SELECT game, event, sum(m) AS matches, sum(p) AS predicted, sum(r) AS reference FROM c GROUP BY GROUPING SETS ((game, event), (event))),
    f AS (SELECT *, CASE WHEN predicted + reference > 0 THEN 2*matches/(predicted + reference) ELSE 0 END AS f1 FROM b)
    SELECT game, """ + f"{_d('sum(f1)/10')} AS macro_f1_fixed_10, {_d('avg(CASE WHEN reference > 0 THEN f1 END)')} AS macro_f1_gt_supported" + """,
      coalesce(string_agg(event, ',' ORDER BY event) FILTER (WHERE reference = 0), '') AS unsupported_classes FROM f GROUP BY game""",
)
def bundle_macro_query(v: Views) -> DataFrame:
    macro = _bundle_scores(v)["macro"]
    return macro.select(
        "game", *[F.round(c, 9).alias(c) for c in ("macro_f1_fixed_10", "macro_f1_gt_supported")], "unsupported_classes"
    )


@query(
    "bundle_sequence",
    _BUNDLE + """, p AS (SELECT sample_id, list(event ORDER BY pos) AS pe, list(coalesce(event || '/' || actor, 'x' || pos) ORDER BY pos) AS pa FROM kept GROUP BY 1),
    r AS (SELECT sample_id, game, list(event ORDER BY pos) AS re, list(coalesce(event || '/' || actor, 'y' || pos) ORDER BY pos) AS ra FROM references_ GROUP BY 1, 2),
    m AS (SELECT game, coalesce(len(pe), 0) AS np, len(re) AS nr, CASE WHEN pe IS NULL THEN 0 ELSE """ + _lcs("pe", "re") + """ END AS t,
        CASE WHEN pe IS NULL THEN 0 ELSE """ + _lcs("pa", "ra") + """ END AS f FROM r LEFT JOIN p ON p.sample_id = r.sample_id)
    SELECT game, CAST(sum(np) AS BIGINT) AS predicted, CAST(sum(nr) AS BIGINT) AS reference, CAST(sum(t) AS BIGINT) AS type_matches,
      CAST(sum(f) AS BIGINT) AS full_matches FROM m GROUP BY GROUPING SETS ((game), ())""",
)
def bundle_sequence_query(v: Views) -> DataFrame:
    scores = _bundle_scores(v)["sequence"]
    return scores.select("game", "predicted", "reference", "type_matches", "full_matches")


def _track_inputs(v: Views):
    """Track truth from clip scores: the label of each person is its reference."""
    from clipledger.operators.scores import gate_segment, player_predictions
    from clipledger.vocabulary import LABELS

    predictions = player_predictions(v.persons).join(
        gate_segment(v.clips, v.score_videos).select("video_id", "person_id", F.struct("start_time", "end_time").alias("gate")),
        ["video_id", "person_id"], "left",
    ).select(
        F.col("video_id").alias("sample_id"), F.col("person_id").alias("player_id"),
        F.regexp_extract("person_id", "([0-9]+)$", 1).cast("int").alias("pos"),
        "event", "class_probabilities", "gate", F.lit(True).alias("has_required"),
    )
    names = F.array(*[F.lit(n) for n in LABELS])
    references = v.persons.filter("label <> 0").select(
        F.col("video_id").alias("sample_id"), F.col("person_id").alias("actor"),
        F.get(names, F.col("label")).alias("event"), F.col("label").alias("pos"),
        F.lit(1.0).alias("interval_start"), F.lit(30.0).alias("interval_end"),
    )
    samples = v.persons.select(F.col("video_id").alias("sample_id")).distinct()
    return samples, references, predictions


@query(
    "score_tracks",
    """WITH n AS (SELECT ['blank','Missed Shot','Made Shot','Free Throw','Foul','Turnover','Jump Ball','Rebound','steal','block','ast'] AS names),
    p AS (SELECT video_id, person_id, names[list_position(p, list_max(p))] AS event FROM person_probabilities, n WHERE valid),
    r AS (SELECT video_id, person_id, names[label + 1] AS event FROM persons, n WHERE label <> 0)
    SELECT e.event, (SELECT count(*) FROM r JOIN p USING (video_id, person_id, event) WHERE event = e.event) AS matches,
      (SELECT count(*) FROM p WHERE p.event = e.event) AS predicted, (SELECT count(*) FROM r WHERE r.event = e.event) AS reference FROM event_labels e""",
)
def score_tracks_query(v: Views) -> DataFrame:
    return mt.score_tracks(*_track_inputs(v))["per_class"].select("event", "matches", "predicted", "reference")


@query(
    "score_tracks_hits",
    """WITH n AS (SELECT ['blank','Missed Shot','Made Shot','Free Throw','Foul','Turnover','Jump Ball','Rebound','steal','block','ast'] AS names),
    p AS (SELECT video_id, person_id, names[list_position(p, list_max(p))] AS event FROM person_probabilities, n WHERE valid),
    g AS (SELECT video_id, person_id, clip_index FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person_id ORDER BY gate DESC, clip_index) AS k FROM clips WHERE valid) WHERE k = 1),
    t AS (SELECT names[label + 1] AS re, p.event AS pe, clip_index AS s, least(clip_index + 2, 50.5) AS e FROM persons q, n LEFT JOIN p ON p.video_id = q.video_id AND p.person_id = q.person_id
      LEFT JOIN g ON g.video_id = q.video_id AND g.person_id = q.person_id WHERE label <> 0)
    SELECT count(*) AS target_count, round(CAST(count(*) FILTER (WHERE re = pe AND greatest(0, least(e, 30) - greatest(s, 1))/least(29, e - s) > 0.5)/count(*) AS DOUBLE), 9) AS hit_at_0_5 FROM t""",
)
def score_tracks_hits_query(v: Views) -> DataFrame:
    hits = mt.score_tracks(*_track_inputs(v))["hits"]
    return hits.select("target_count", F.round("hit_at_0_5", 9).alias("hit_at_0_5"))


@query(
    "score_tracks_recall",
    """WITH n AS (SELECT ['blank','Missed Shot','Made Shot','Free Throw','Foul','Turnover','Jump Ball','Rebound','steal','block','ast'] AS names),
    x AS (SELECT video_id, person_id, CAST(regexp_extract(person_id, '([0-9]+)$', 1) AS INTEGER) AS pos, unnest(p) AS c, generate_subscripts(p, 1) AS i FROM person_probabilities WHERE valid),
    k AS (SELECT video_id, person_id, names[i] AS event, row_number() OVER (PARTITION BY video_id ORDER BY c DESC, pos, i) AS k FROM x, n WHERE i > 1),
    r AS (SELECT video_id, person_id, names[label + 1] AS event FROM persons, n WHERE label <> 0),
    q AS (SELECT r.event, k.k FROM r LEFT JOIN k USING (video_id, person_id, event)),
    c AS (SELECT event, count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE k <= {k}) AS f{k}" for k in (1, 3, 5)) + """ FROM q GROUP BY 1)
    SELECT """ + ", ".join(_d(f"sum(f{k}/n)/10") + f" AS recall_at_{k}" for k in (1, 3, 5)) + " FROM c",
)
def score_tracks_recall_query(v: Views) -> DataFrame:
    recall = mt.score_tracks(*_track_inputs(v))["recall"]
    return recall.select(*[F.round(c, 9).alias(c) for c in recall.columns])


@query(
    "compare_expected",
    """WITH e AS (SELECT 'm' || o_orderkey AS clip_id, 'player_' || (1 + o_custkey % 7) AS player_id, CASE WHEN o_orderstatus = 'F' THEN 'ast' ELSE 'Foul' END AS expected_event FROM orders),
    p AS (SELECT material_id, player_id, arg_min({'e': event, 'c': confidence}, pos) AS p FROM predictions GROUP BY 1, 2)
    SELECT e.*, CASE WHEN p.p IS NULL THEN 'missing_player_prediction' ELSE 'completed' END AS status, p.p.e AS actual_event, p.p.c AS confidence,
      coalesce(p.p.e = expected_event, false) AS matched FROM e LEFT JOIN p ON p.material_id = e.clip_id AND p.player_id = e.player_id""",
)
def compare_expected_query(v: Views) -> DataFrame:
    expected = v.table("orders").select(
        text("m", F.col("o_orderkey")).alias("clip_id"),
        text("player_", 1 + F.col("o_custkey") % 7).alias("player_id"),
        F.when(F.col("o_orderstatus") == "F", " Assisted ").otherwise("Foul ").alias("expected_event"),
    )
    return mt.compare_expected(expected, v.predictions.withColumnRenamed("material_id", "clip_id"))


# -------------------------------------------------------------------- bundles


def _bundle_inputs(v: Views):
    clips = v.game_orders.select(
        "game", F.col("o_orderkey").cast("string").alias("clip"), F.floor("o_totalprice").alias("size_bytes")
    )
    from clipledger.operators.labels import draft_events

    keyed = v.game_orders.select("game", F.col("o_orderkey").cast("string").alias("clip"), text("o", F.col("o_orderkey")).alias("clip_id"))
    events = draft_events(v.actions).join(keyed, "clip_id").select("game", "clip", "event")
    return clips, events


_STRATA = """strata AS (SELECT game, CAST(o_orderkey AS VARCHAR) AS clip, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
      list(DISTINCT label ORDER BY label) FILTER (WHERE label IS NOT NULL) AS s, sha256('11|' || game || '|' || o_orderkey) AS h
      FROM game_orders LEFT JOIN contributions ON clip_id = 'o' || o_orderkey GROUP BY game, o_orderkey, o_totalprice)"""


@query(
    "sample_bundle",
    f"""WITH RECURSIVE {_STRATA},
    lab AS (SELECT event, row_number() OVER (ORDER BY n, event) AS i FROM (SELECT e.event, count(c.label) AS n FROM event_labels e
      LEFT JOIN contributions c ON c.label = e.event GROUP BY 1)),
    lists AS (SELECT i, event, coalesce((SELECT list({{'g': game, 'c': clip, 's': s}} ORDER BY h, game, clip) FROM strata WHERE list_contains(s, event)), []) AS l FROM lab),
    walk AS (SELECT 0::BIGINT AS i, []::STRUCT(g VARCHAR, c VARCHAR, s VARCHAR[])[] AS sel
      UNION ALL SELECT n.i, list_concat(sel, list_filter(n.l, lambda x: NOT list_contains(sel, x))[1:greatest(0, 4 - len(list_filter(sel, lambda x: list_contains(x.s, n.event))))])
      FROM walk w JOIN lists n ON n.i = w.i + 1)
    SELECT game, clip, size_bytes, coalesce(array_to_string(s, ','), '') AS strata FROM strata WHERE (game, clip) IN
      (SELECT (x.g, x.c) FROM (SELECT unnest(sel) AS x FROM walk WHERE i = 10))""",
)
def sample_bundle_query(v: Views) -> DataFrame:
    chosen = bd.sample_bundle(*_bundle_inputs(v), seed=11, per_class=4)
    return chosen.withColumn("strata", F.array_join("strata", ","))


@query(
    "sample_bundle_all",
    f"WITH {_STRATA} SELECT game, clip, size_bytes, coalesce(array_to_string(s, ','), '') AS strata FROM strata",
)
def sample_bundle_all_query(v: Views) -> DataFrame:
    chosen = bd.sample_bundle(*_bundle_inputs(v), seed=11, per_class=4, all_clips=True)
    return chosen.withColumn("strata", F.array_join("strata", ","))


@query(
    "class_coverage",
    f"WITH {_STRATA} SELECT e.event, count(x.event) AS clips FROM event_labels e LEFT JOIN (SELECT unnest(s) AS event FROM strata) x ON x.event = e.event GROUP BY 1",
)
def class_coverage_query(v: Views) -> DataFrame:
    return bd.class_coverage(bd.clip_strata(*_bundle_inputs(v)))


@query(
    "bundle_totals",
    f"WITH {_STRATA} SELECT count(*) AS clips, count(*) FILTER (WHERE s IS NULL) AS unmapped_candidate_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM strata",
)
def bundle_totals_query(v: Views) -> DataFrame:
    return bd.bundle_totals(bd.clip_strata(*_bundle_inputs(v)))


@query(
    "pick_games",
    "SELECT game FROM (SELECT DISTINCT game FROM game_orders) ORDER BY sha256('3|' || game) LIMIT 6",
)
def pick_games_query(v: Views) -> DataFrame:
    return bd.pick_games(v.game_orders, seed=3, count=6)


# ------------------------------------------------------------------ job state


def _plan(v: Views) -> DataFrame:
    plan = v.windows.select(
        F.col("source_video_id").alias("video_id"), F.col("segment_id").alias("window_id"),
        F.lit(720).alias("window"), F.lit(2).alias("topk"), F.lit(0).alias("device"),
    )
    return inc.config_hash(plan, ["window", "topk"])


def _window_status(v: Views) -> DataFrame:
    """Windows with events succeeded, on another device; some had other settings."""
    status = v.evidence.groupBy(
        "video_id", F.format_string("%s_%05d", "video_id", F.floor(F.col("t") / 600)).alias("window_id")
    ).agg(F.max("value").alias("top"), F.lit(720).alias("window"), F.lit(1).alias("device"))
    status = status.withColumn("topk", F.when(F.col("top") > 300, 3).otherwise(2)).withColumn(
        "status", F.when(F.col("top") < 20, "failed").otherwise("succeeded")
    )
    return inc.config_hash(status, ["window", "topk"])


_STATUS = """st AS (SELECT video_id, printf('%s_%05d', video_id, CAST(floor(t/600) AS BIGINT)) AS window_id, max(value) AS top FROM evidence GROUP BY 1, 2)"""


@query(
    "pending_windows",
    f"""WITH {_STATUS} SELECT source_video_id AS video_id, segment_id AS window_id FROM windows
    WHERE segment_id NOT IN (SELECT window_id FROM st WHERE top >= 20 AND top <= 300)""",
)
def pending_windows_query(v: Views) -> DataFrame:
    return inc.pending_windows(_plan(v), _window_status(v)).select("video_id", "window_id")


@query("config_conflicts", f"WITH {_STATUS} SELECT DISTINCT video_id FROM st WHERE top > 300")
def config_conflicts_query(v: Views) -> DataFrame:
    return inc.config_conflicts(_plan(v), _window_status(v))


@query(
    "job_summary",
    f"""WITH {_STATUS} SELECT video_id, count(*) AS windows, count(*) FILTER (WHERE top < 20) AS failed_windows, CAST(0 AS BIGINT) AS failed_identities,
      CASE WHEN count(*) FILTER (WHERE top < 20) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM st GROUP BY 1""",
)
def job_summary_query(v: Views) -> DataFrame:
    return inc.job_summary(_window_status(v), allow_partial=True)
