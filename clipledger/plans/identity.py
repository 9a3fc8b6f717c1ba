"""Queries on identity evidence."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.operators import identity as idn
from clipledger.operators import observations as obs
from clipledger.operators.hooks import score_with
from clipledger.plans.registry import query
from clipledger.plans.views import Views, text

_SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim({})), '[^0-9a-z_.-]+', '-', 'g'), '-'), ''), 'unknown')"

_CANDIDATES = """(SELECT track_ref, jersey_color, jersey_number, count(*) AS support_count, sum(confidence) AS confidence_sum,
      string_agg(CAST(frame_index AS VARCHAR), ',' ORDER BY frame_index) AS frames
    FROM observations WHERE is_on_court_player AND jersey_color IS NOT NULL AND jersey_number IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "identity_candidates",
    f"SELECT track_ref, jersey_color, jersey_number, support_count, round(confidence_sum, 6) AS confidence_sum, frames FROM {_CANDIDATES}",
)
def candidates_query(v: Views) -> DataFrame:
    return idn.identity_candidates(v.observations).select(
        "track_ref", "jersey_color", "jersey_number", "support_count",
        F.round("confidence_sum", 6).alias("confidence_sum"),
        F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"),
    )


_RESOLVED = f"""WITH c AS (SELECT track_ref, count(*) AS n, min(jersey_color) AS color, min(jersey_number) AS number FROM {_CANDIDATES} GROUP BY 1),
    col AS (SELECT track_ref, min(jersey_color) AS color FROM observations WHERE is_on_court_player AND jersey_color IS NOT NULL
      GROUP BY 1 HAVING count(DISTINCT jersey_color) = 1),
    names AS (SELECT game, lower(trim(color)) AS color, jersey, min(name) AS name FROM roster GROUP BY 1, 2, 3 HAVING count(*) = 1),
    seen AS (SELECT track_ref, count(*) AS k FROM observations GROUP BY 1),
    d AS (SELECT t.*, CASE WHEN n IS NULL THEN 'anonymous' WHEN n = 1 THEN 'identified' ELSE 'conflicting' END AS status,
        CASE WHEN n = 1 THEN c.color ELSE col.color END AS jersey_color, CASE WHEN n = 1 THEN c.number END AS jersey_number, coalesce(k, 0) AS observation_count
      FROM identity_tracks t LEFT JOIN c USING (track_ref) LEFT JOIN col USING (track_ref) LEFT JOIN seen USING (track_ref)),
    resolved AS (SELECT d.*, CASE WHEN status = 'identified' THEN {_SLUG.format('d.game')} || ':jersey:' || jersey_color || ':' || jersey_number
        ELSE {_SLUG.format('d.game')} || ':clip:' || {_SLUG.format('clip_id')} || ':track:' || {_SLUG.format('track_id')} END AS participant_id,
      name AS player_name FROM d LEFT JOIN names ON names.game = d.game AND names.color = d.jersey_color AND names.jersey = d.jersey_number)"""


def _resolved(v: Views) -> DataFrame:
    return idn.resolve_identity(v.identity_tracks, v.observations, v.roster)


@query("resolve_identity", _RESOLVED + " SELECT * FROM resolved")
def resolve_query(v: Views) -> DataFrame:
    return _resolved(v).drop("reason")


@query(
    "decision_candidates",
    f"""SELECT t.track_ref, coalesce(string_agg(jersey_color || '#' || jersey_number || 'x' || support_count, ','
      ORDER BY support_count DESC, confidence_sum DESC, jersey_color, jersey_number), '') AS candidates
    FROM identity_tracks t LEFT JOIN (SELECT track_ref, jersey_color, jersey_number, support_count, round(confidence_sum, 6) AS confidence_sum
      FROM {_CANDIDATES}) c USING (track_ref) GROUP BY 1""",
)
def decision_candidates_query(v: Views) -> DataFrame:
    candidates = idn.identity_candidates(v.observations).withColumn(
        "confidence_sum", F.round("confidence_sum", 6)
    )
    nested = idn.decision_candidates(v.identity_tracks.select("track_ref"), candidates)
    label = F.transform(
        "candidates",
        lambda c: F.concat(c["jersey_color"], F.lit("#"), c["jersey_number"], F.lit("x"), c["support_count"].cast("string")),
    )
    return nested.select("track_ref", F.coalesce(F.array_join(label, ","), F.lit("")).alias("candidates"))


@query(
    "roster_unique_name",
    """SELECT game, lower(trim(color)) AS jersey_color, jersey AS jersey_number, CASE WHEN count(*) = 1 THEN min(name) END AS player_name
    FROM roster GROUP BY 1, 2, 3""",
)
def roster_names_query(v: Views) -> DataFrame:
    return idn.roster_names(v.roster)


@query(
    "roster_lookup",
    """WITH i AS (SELECT 'o' || l_orderkey AS track_ref, l_partkey*1000000 + l_suppkey*10 + l_linenumber AS pos, 'Game ' || (l_orderkey % 25) AS game,
        CASE WHEN l_quantity > 5 THEN CASE l_returnflag WHEN 'A' THEN 'white' WHEN 'N' THEN 'black' ELSE 'red' END END AS jersey_color,
        CASE WHEN l_tax < 0.07 THEN CASE l_linenumber % 3 WHEN 0 THEN '0' WHEN 1 THEN '00' ELSE '13' END END AS jersey_number FROM lineitem),
    n AS (SELECT game, lower(trim(color)) AS color, jersey, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS k FROM roster GROUP BY 1, 2, 3)
    SELECT track_ref, pos, i.game, jersey_color, jersey_number, CASE WHEN jersey_color IS NULL OR jersey_number IS NULL THEN 'invalid_identity'
        WHEN k IS NULL THEN 'no_match' WHEN k > 1 THEN 'ambiguous' ELSE 'matched' END AS lookup_status,
      CASE WHEN k = 1 THEN names END AS player_name, coalesce(names, '') AS candidate_names
    FROM i LEFT JOIN n ON n.game = i.game AND n.color = jersey_color AND n.jersey = jersey_number""",
)
def roster_lookup_query(v: Views) -> DataFrame:
    line = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    identities = v.table("lineitem").select(
        text("o", F.col("l_orderkey")).alias("track_ref"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("pos"),
        text("Game ", F.col("l_orderkey") % 25).alias("game"),
        F.when(F.col("l_quantity") > 5, F.when(flag == "A", " WHITE ").when(flag == "N", "Black").otherwise("red")).alias("jersey_color"),
        F.when(F.col("l_tax") < 0.07, F.when(line % 3 == 0, "0").when(line % 3 == 1, " 00").otherwise("13"))
        .otherwise("1x").alias("jersey_number"),
    )
    # a list is joined to text once, not once for every row that it is told to
    names = idn.roster_candidates(v.roster).withColumn("candidate_names", F.array_join("candidate_names", ","))
    return idn.find_candidates(identities, names, "shuffle_hash").select(
        "track_ref", "pos", "game", "jersey_color", "jersey_number", "lookup_status", "player_name",
        F.coalesce("candidate_names", F.lit("")).alias("candidate_names"),
    )


_VALID = """WITH o AS (SELECT 'o' || l_orderkey AS track_ref, CAST(l_partkey*7 + l_linenumber AS INTEGER) AS frame_index, l_suppkey*10 + l_linenumber AS pos,
        CASE WHEN l_linenumber = 7 THEN 'model_output_inconsistency' WHEN l_linenumber = 6 THEN 'unresolved' ELSE 'valid' END AS status,
        CASE WHEN l_returnflag <> 'R' THEN 'white' END AS jersey_color, CAST(l_suppkey % 2 AS VARCHAR) AS jersey_number,
        l_discount*10 AS confidence FROM lineitem),
    e AS (SELECT * FROM o WHERE status = 'valid' AND confidence >= 0.6),
    c AS (SELECT track_ref, jersey_color, jersey_number, count(*) AS support_count, round(sum(confidence), 4) AS confidence_sum,
        string_agg(CAST(frame_index AS VARCHAR), ',' ORDER BY frame_index) AS frames FROM e GROUP BY 1, 2, 3)"""


def _validated(v: Views) -> DataFrame:
    line = F.col("l_linenumber")
    return v.table("lineitem").select(
        text("o", F.col("l_orderkey")).alias("track_ref"),
        (F.col("l_partkey") * 7 + line).cast("int").alias("frame_index"),
        (F.col("l_suppkey") * 10 + line).alias("pos"),
        F.when(line == 7, "model_output_inconsistency").when(line == 6, "unresolved").otherwise("valid").alias("status"),
        F.when(F.col("l_returnflag") != "R", "white").alias("jersey_color"),
        (F.col("l_suppkey") % 2).cast("string").alias("jersey_number"),
        (F.col("l_discount") * 10).alias("number_confidence"),
    )


def _aggregated(v: Views):
    return idn.aggregate_observations(_validated(v), v.identity_tracks)


@query(
    "observation_status",
    _VALID + """, g AS (SELECT track_ref, count(*) AS n, min(jersey_color) AS jersey_color, min(jersey_number) AS jersey_number, sum(support_count) AS k FROM c GROUP BY 1),
    i AS (SELECT track_ref, count(*) AS m FROM o WHERE status = 'model_output_inconsistency' GROUP BY 1)
    SELECT t.track_ref, CASE WHEN n >= 2 THEN 'mixed_identity' WHEN n = 1 THEN 'stable_identity' WHEN m > 0 THEN 'model_output_inconsistency'
        ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN jersey_color END AS jersey_color, CASE WHEN n = 1 THEN jersey_number END AS jersey_number,
      CAST(coalesce(k, 0) AS BIGINT) AS valid_evidence_count, coalesce(m, 0) AS model_output_inconsistency_count
    FROM identity_tracks t LEFT JOIN g USING (track_ref) LEFT JOIN i USING (track_ref)""",
)
def observation_status_query(v: Views) -> DataFrame:
    return _aggregated(v)[0]


@query("observation_candidates", _VALID + " SELECT * FROM c")
def observation_candidates_query(v: Views) -> DataFrame:
    return _aggregated(v)[1].withColumn(
        "frames", F.array_join(F.col("frames").cast("array<string>"), ",")
    )


@query(
    "observation_segments",
    _VALID + """, b AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(jersey_color) OVER w IS NOT DISTINCT FROM jersey_color
        AND lag(jersey_number) OVER w = jersey_number THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY track_ref ORDER BY frame_index, pos)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY track_ref ORDER BY frame_index, pos ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT track_ref, jersey_color, jersey_number, min(frame_index) AS start_frame, max(frame_index) AS end_frame,
      string_agg(CAST(frame_index AS VARCHAR), ',' ORDER BY frame_index) AS observation_frames FROM r GROUP BY track_ref, run, jersey_color, jersey_number""",
)
def observation_segments_query(v: Views) -> DataFrame:
    return _aggregated(v)[2].withColumn(
        "observation_frames", F.array_join(F.col("observation_frames").cast("array<string>"), ",")
    )


# Events of the actor query: one per customer, its references are the customer's orders.
def _actor_events(v: Views) -> DataFrame:
    ref = text("w", F.expr("o_orderkey div 7"), "/o", F.col("o_orderkey"))
    return v.table("orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", ref.alias("r")))), lambda s: s["r"]).alias("track_references")
    ).select(
        text("event ", F.col("o_custkey")).alias("event_id"),
        F.lit("Foul").alias("event"),
        text("v", F.expr("o_custkey div 10")).alias("source_video_id"),
        "track_references",
    )


def _evidence_status(v: Views) -> DataFrame:
    return v.table("orders").select(
        text("w", F.expr("o_orderkey div 7"), "/o", F.col("o_orderkey")).alias("track_ref"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(10).alias("sample_count"),
        F.lit(0.0).alias("pad_ratio"),
    )


def _actor_observations(v: Views) -> DataFrame:
    key = F.regexp_extract("track_ref", "([0-9]+)$", 1).cast("bigint")
    completed = v.observations.withColumn("k", key)
    return completed.withColumn("track_ref", text("w", F.expr("k div 7"), "/o", F.col("k"))).drop("k").join(
        _evidence_status(v).filter("status = 'completed'").select("track_ref"), "track_ref", "left_semi"
    )


_ACTOR = f"""WITH c AS (SELECT o_custkey, jersey_color, jersey_number FROM orders JOIN observations ON track_ref = 'o' || o_orderkey
      WHERE o_orderstatus <> 'P' AND is_on_court_player AND jersey_color IS NOT NULL AND jersey_number IS NOT NULL GROUP BY 1, 2, 3),
    g AS (SELECT o_custkey, count(*) AS n, min(jersey_color) AS color, min(jersey_number) AS number FROM c GROUP BY 1),
    col AS (SELECT o_custkey, min(jersey_color) AS color FROM orders JOIN observations ON track_ref = 'o' || o_orderkey
      WHERE o_orderstatus <> 'P' AND is_on_court_player AND jersey_color IS NOT NULL GROUP BY 1 HAVING count(DISTINCT jersey_color) = 1),
    f AS (SELECT o_custkey, 'v' || (o_custkey // 10) AS source_video_id, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_reference_count,
        coalesce(string_agg('w' || (o_orderkey // 7) || '/o' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P'), '') AS failed,
        count(*) AS refs FROM orders GROUP BY 1, 2),
    k AS (SELECT o_custkey, count(*) AS k FROM orders JOIN observations ON track_ref = 'o' || o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1)"""


@query(
    "event_actor_identity",
    _ACTOR + """ SELECT 'event ' || f.o_custkey AS event_id, source_video_id, CASE WHEN n IS NULL THEN 'anonymous' WHEN n = 1 THEN 'identified' ELSE 'conflicting' END AS status,
      CASE WHEN n = 1 THEN source_video_id || ':jersey:' || g.color || ':' || number
        ELSE source_video_id || ':clip:event-' || f.o_custkey || ':track:event-' || f.o_custkey END AS participant_id,
      CASE WHEN n = 1 THEN g.color ELSE col.color END AS jersey_color, CASE WHEN n = 1 THEN number END AS jersey_number,
      coalesce(k, 0) AS observation_count, failed_reference_count, failed AS failed_track_references
    FROM f LEFT JOIN g USING (o_custkey) LEFT JOIN col USING (o_custkey) LEFT JOIN k USING (o_custkey)""",
)
def event_actor_query(v: Views) -> DataFrame:
    decided = idn.event_actor_identity(_actor_events(v), _evidence_status(v), _actor_observations(v))
    return decided.select(
        "event_id", "source_video_id", "status", "participant_id", "jersey_color", "jersey_number",
        "observation_count", "failed_reference_count",
        F.array_join("failed_track_references", ",").alias("failed_track_references"),
    )


@query(
    "identity_report",
    _ACTOR + """ SELECT source_video_id, count(*) AS event_count, CAST(sum(refs) AS BIGINT) AS unique_track_reference_count,
      CAST(sum(failed_reference_count) AS BIGINT) AS failed_track_reference_count FROM f GROUP BY 1""",
)
def identity_report_query(v: Views) -> DataFrame:
    events = _actor_events(v)
    return idn.identity_report(events, _evidence_status(v))


@query(
    "reusable_evidence",
    """SELECT 'w' || (o_orderkey // 7) || '/o' || o_orderkey AS track_ref,
      CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' THEN 'reused' ELSE 'pending' END AS state FROM orders""",
)
def reusable_evidence_query(v: Views) -> DataFrame:
    references = idn.distinct_references(idn.event_references(_actor_events(v)))
    reused, pending = idn.reusable_evidence(references, _evidence_status(v), 10, 0.0)
    return reused.select("track_ref", F.lit("reused").alias("state")).unionByName(
        pending.select("track_ref", F.lit("pending").alias("state"))
    )


@query(
    "reusable_video_reports",
    """SELECT 'v' || (o_custkey // 10) AS video_id FROM orders GROUP BY 1
    HAVING count(*) FILTER (WHERE o_totalprice > 490000) = 0""",
)
def reusable_reports_query(v: Views) -> DataFrame:
    reports = v.table("orders").groupBy(text("v", F.expr("o_custkey div 10")).alias("video_id")).agg(
        F.lit("completed_with_warnings").alias("status"),
        F.lit(10).alias("sample_count"),
        F.lit(0.0).alias("pad_ratio"),
        F.count_if(F.col("o_totalprice") > 490000).alias("failed_track_reference_count"),
    )
    return idn.reusable_video_reports(reports, 10, 0.0).select("video_id")


def _resolutions(v: Views) -> DataFrame:
    """Identity reports of materials: one per order, one row per line."""
    line = F.col("l_linenumber")
    return v.table("lineitem").select(
        text("v", F.expr("l_orderkey div 100")).alias("source_video_id"),
        text("m", F.col("l_orderkey")).alias("material_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("pos"),
        text("player_", line).alias("track_id"),
        F.when(line <= 4, "identified").when(line == 5, "conflicting").alias("status"),
        F.when(F.col("l_returnflag") == "A", " White").when(F.col("l_returnflag") == "N", "black").alias("jersey_color"),
        (F.col("l_suppkey") % 12).cast("string").alias("jersey_number"),
        F.lit(None).cast("string").alias("participant_id"),
        text("name ", F.col("l_suppkey")).alias("player_name"),
    )


_ASSOC = """WITH r AS (SELECT 'v' || (l_orderkey // 100) AS source_video_id, 'm' || l_orderkey AS material_id, l_partkey*1000000 + l_suppkey*10 + l_linenumber AS pos,
        'player_' || l_linenumber AS track_id, CASE WHEN l_linenumber <= 4 THEN 'identified' WHEN l_linenumber = 5 THEN 'conflicting' ELSE 'anonymous' END AS identity_status,
        CASE l_returnflag WHEN 'A' THEN 'white' WHEN 'N' THEN 'black' END AS jersey_color, CAST(l_suppkey % 12 AS VARCHAR) AS jersey_number, 'name ' || l_suppkey AS player_name FROM lineitem),
    q AS (SELECT *, CASE WHEN identity_status = 'identified' AND jersey_color IS NOT NULL THEN source_video_id || ':jersey:' || jersey_color || ':' || jersey_number
        ELSE source_video_id || ':material:' || material_id || ':track:' || track_id END AS participant_id,
      CASE WHEN identity_status = 'identified' AND jersey_color IS NOT NULL THEN 'jersey_color_and_number' ELSE 'material_scoped_anonymous' END AS association_method FROM r)"""


@query("associate_references", _ASSOC + " SELECT * FROM q")
def associate_references_query(v: Views) -> DataFrame:
    return idn.associate_across_materials(_resolutions(v))[0]


@query(
    "associate_profiles",
    _ASSOC + """ SELECT source_video_id, participant_id, arg_min(player_name, (material_id, pos)) AS display_name, arg_min({'c': jersey_color}, (material_id, pos)).c AS jersey_color,
      arg_min(jersey_number, (material_id, pos)) AS jersey_number, count(*) AS appearance_count, string_agg(DISTINCT material_id, ',' ORDER BY material_id) AS material_ids
    FROM q GROUP BY 1, 2""",
)
def associate_profiles_query(v: Views) -> DataFrame:
    profiles = idn.associate_across_materials(_resolutions(v))[1]
    return profiles.withColumn("material_ids", F.array_join("material_ids", ","))


@query(
    "observer_errors",
    """SELECT 'o' || o_orderkey AS track_ref, CASE WHEN o_totalprice > 495000 THEN 0 ELSE coalesce(n, 0) END AS observation_count,
      CASE WHEN o_totalprice > 495000 THEN 'ValueError: no usable image' END AS error
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def observer_errors_query(v: Views) -> DataFrame:
    """The observer hook on every track; failed tracks keep a row with the error."""
    counts = v.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    inputs = v.table("orders").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        text("o", F.col("o_orderkey")).alias("track_ref"),
        "o_totalprice",
        F.coalesce("n", F.lit(0)).alias("n"),
    )

    def observe(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["o_totalprice"] > 495000).any():
            raise ValueError("no usable image")
        return pd.DataFrame({"observation_count": batch["n"]})

    results = score_with(inputs, observe, "observation_count bigint", ["track_ref"])
    return idn.with_observer_errors(v.identity_tracks.select("track_ref"), results)


# ---------------------------------------------------------------- model texts


def _model_outputs(v: Views) -> tuple[DataFrame, DataFrame]:
    """Model texts in four shapes, one per order, written from its lines."""
    line = F.col("l_linenumber")
    item = F.to_json(
        F.struct(
            line.alias("image_index"),
            (line <= 5).alias("is_on_court_player"),
            F.when(F.col("l_returnflag") == "A", " White").otherwise("black").alias("jersey_color"),
            (F.col("l_suppkey") % 150).cast("string").alias("jersey_number"),
            F.when(F.col("l_tax") > 0.05, "high").otherwise("low").alias("confidence"),
        )
    )
    rows = v.table("lineitem").select(
        "l_orderkey", line.alias("image_index"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("pos"), item.alias("item")
    )
    grouped = rows.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items")
    )
    shape = F.col("l_orderkey") % 4
    comma, lines = F.array_join("items", ","), F.array_join("items", "\n```\n```json\n")
    body = (
        F.when(shape == 0, F.concat(F.lit('{"observations": ['), comma, F.lit("]}")))
        .when(shape == 1, F.concat(F.lit("["), comma, F.lit("]")))
        .when(shape == 2, F.concat(F.lit("```json\n"), lines, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here: "), F.array_join("items", " and then {broken "), F.lit(" done")))
    )
    outputs = grouped.select(text("o", F.col("l_orderkey")).alias("track_ref"), body.alias("output_text"))
    crops = v.table("orders").select(
        text("o", F.col("o_orderkey")).alias("track_ref"),
        F.explode(F.sequence(F.lit(1), F.lit(6))).alias("image_index"),
    ).withColumn("frame_index", F.col("image_index") * 10)
    return outputs, crops


@query(
    "parse_observations",
    """SELECT track_ref, image_index, image_index*10 AS frame_index, is_on_court_player, jersey_color, jersey_number, confidence FROM (
      SELECT 'o' || l_orderkey AS track_ref, l_linenumber AS image_index, l_linenumber <= 5 AS is_on_court_player,
        CASE l_returnflag WHEN 'A' THEN 'white' ELSE 'black' END AS jersey_color,
        CASE WHEN l_suppkey % 150 < 100 THEN CAST(l_suppkey % 150 AS VARCHAR) END AS jersey_number,
        CASE WHEN l_tax > 0.05 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey*1000000 + l_suppkey*10 + l_linenumber) AS r FROM lineitem)
    WHERE r = 1 AND image_index <= 6""",
)
def parse_observations_query(v: Views) -> DataFrame:
    outputs, crops = _model_outputs(v)
    return obs.parse_observations(outputs, crops)[0].drop("pos", "evidence")


@query(
    "parse_json_response",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ok' WHEN role = 'assistant' THEN 'not_an_object' ELSE 'not_json' END AS outcome
    FROM conversations""",
)
def parse_json_response_query(v: Views) -> DataFrame:
    """Wrap every conversation turn the way models answer, then parse it."""
    body = F.to_json(F.struct("turn", "text"))
    quoted = F.to_json(F.array(F.col("turn")))
    answer = (
        F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("role") == "assistant", quoted)
        .otherwise(F.concat(F.lit("answer: {"), F.col("turn").cast("string"), F.lit("}")))
    )
    parsed = v.table("conversations").select("conv_id", "turn", obs.parse_json_response(answer).alias("p"))
    return parsed.select("conv_id", "turn", F.coalesce("p.error", F.lit("ok")).alias("outcome"))


def _responses(v: Views) -> DataFrame:
    line = F.col("l_linenumber")
    return v.table("lineitem").select(
        (F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + line).alias("response_id"),
        F.when(F.col("l_tax") == 0.08, "not_json").alias("parse_error"),
        F.when(line < 6, True).when(line == 6, False).alias("is_on_court_player"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 25).otherwise(F.lit(True)).alias("number_readable"),
        F.when(F.col("l_returnflag") == "A", "White").when(F.col("l_returnflag") == "N", "green").alias("jersey_color_candidate"),
        F.when(F.col("l_quantity") > 20, (F.col("l_suppkey") % 120).cast("string")).alias("jersey_number_candidate"),
        (F.col("l_discount") * 12).alias("number_confidence"),
    )


_RESP = """WITH r AS (SELECT l_partkey*1000000 + l_orderkey*10 + l_linenumber AS response_id, l_tax = 0.08 AS failed,
        CASE WHEN l_linenumber < 6 THEN true WHEN l_linenumber = 6 THEN false END AS court,
        CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 ELSE true END AS readable,
        CASE l_returnflag WHEN 'A' THEN 'white' WHEN 'N' THEN 'green' END AS color,
        CASE WHEN l_quantity > 20 AND l_suppkey % 120 < 100 THEN CAST(l_suppkey % 120 AS VARCHAR) END AS number,
        CASE WHEN l_discount*12 <= 1 THEN l_discount*12 END AS conf FROM lineitem),
    q AS (SELECT *, list_filter([CASE WHEN court IS NULL THEN 'court_flag_type' END,
        CASE WHEN color = 'green' THEN 'color_not_allowed=green' END,
        CASE WHEN conf IS NULL THEN 'confidence_range' END,
        CASE WHEN NOT readable AND number IS NOT NULL THEN 'number_despite_unreadable' END,
        CASE WHEN readable AND number IS NULL THEN 'number_missing' END,
        CASE WHEN NOT readable AND conf <> 0 THEN 'confidence_despite_unreadable' END], lambda x: x IS NOT NULL) AS issues FROM r)"""


@query(
    "validate_observation",
    _RESP + """ SELECT response_id, CASE WHEN failed THEN 'json_parse' WHEN len(issues) > 0 THEN 'model_output_inconsistency'
        WHEN court AND readable AND number IS NOT NULL THEN 'valid' ELSE 'unresolved' END AS status,
      CASE WHEN failed THEN 'not_json' ELSE array_to_string(issues, '; ') END AS issues,
      CASE WHEN NOT failed AND color = 'white' THEN color END AS jersey_color, CASE WHEN NOT failed THEN number END AS jersey_number FROM q""",
)
def validate_observation_query(v: Views) -> DataFrame:
    checked = obs.validate_observation(_responses(v), ["white", "black"])
    return checked.select(
        "response_id", "status", F.array_join("issues", "; ").alias("issues"), "jersey_color", "jersey_number"
    )


def _noted(v: Views) -> DataFrame:
    line = F.col("l_linenumber")
    number = (F.col("l_suppkey") % 100).cast("string")
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("response_id"),
        line.alias("image_index"),
        F.when(F.col("l_quantity") > 20, number).alias("jersey_number"),
        (F.col("l_linestatus") == "F").alias("number_readable"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.lit("white shirt, Number "), number, F.lit(" seen"))).alias("note"),
    )


_NOTED = """(SELECT l_orderkey AS response_id, unnest(list_filter([
      CASE WHEN l_quantity > 20 AND l_linestatus <> 'F' THEN 'image=' || l_linenumber || ' number_despite_unreadable=' || (l_suppkey % 100) END,
      CASE WHEN l_quantity <= 20 AND l_discount > 0.05 THEN 'image=' || l_linenumber || ' number_only_in_note=' || (l_suppkey % 100) END],
      lambda x: x IS NOT NULL)) AS contradiction FROM lineitem)"""


@query("output_contradictions", f"SELECT response_id, contradiction FROM {_NOTED}")
def contradictions_query(v: Views) -> DataFrame:
    return obs.output_contradictions(_noted(v))


@query(
    "failure_stage",
    f"""SELECT 'o' || o_orderkey AS response_id, CASE WHEN o_totalprice < 20000 THEN 'json_parse' WHEN n > 0 THEN 'model_output_inconsistency'
      WHEN o_orderstatus = 'P' THEN 'on_court_validation' WHEN o_orderpriority = '1-URGENT' THEN 'jersey_color' WHEN o_custkey % 120 >= 100 THEN 'jersey_number'
      WHEN o_orderstatus = 'O' THEN 'roster_lookup' ELSE 'complete' END AS stage
    FROM orders LEFT JOIN (SELECT response_id, count(*) AS n FROM {_NOTED} GROUP BY 1) ON response_id = o_orderkey""",
)
def failure_stage_query(v: Views) -> DataFrame:
    found = obs.output_contradictions(_noted(v)).groupBy("response_id").agg(F.count(F.lit(1)).alias("n"))
    joined = v.table("orders").join(found, F.col("response_id") == F.col("o_orderkey"), "left")
    responses = joined.select(
        text("o", F.col("o_orderkey")).alias("response_id"),
        F.when(F.col("o_totalprice") < 20000, "not_json").alias("parse_error"),
        F.coalesce("n", F.lit(0)).alias("contradiction_count"),
        (F.col("o_orderstatus") != "P").alias("is_on_court_player"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "white").alias("jersey_color"),
        (F.col("o_custkey") % 120).cast("string").alias("jersey_number"),
        F.when(F.col("o_orderstatus") == "F", "matched").otherwise("no_match").alias("lookup_status"),
    )
    return obs.failure_stage(responses).select("response_id", "stage")
