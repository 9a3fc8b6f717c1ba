"""Queries on tracks, sampling and ball candidates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.numbers import spread_positions
from clipledger.functions.boxes import box_array, castable_box, is_box, is_finite_box
from clipledger.operators import tracks as tr
from clipledger.operators import windows as win
from clipledger.plans.registry import query
from clipledger.plans.views import Views, text


@query(
    "uniform_sample",
    """WITH valid AS (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS pos,
        count(*) OVER (PARTITION BY clip_id, track_id) AS n
      FROM boxes WHERE track_id LIKE 'player%' AND w > 1 AND h > 1),
    wanted AS (SELECT DISTINCT clip_id, track_id, CASE WHEN n <= 10 THEN i
        ELSE CAST(round_even(i*((n - 1)/CAST(9 AS DOUBLE)), 0) AS BIGINT) END AS pos
      FROM (SELECT DISTINCT clip_id, track_id, n, unnest(generate_series(0, 9)) AS i FROM valid))
    SELECT clip_id, track_id, frame, x, y, w, h, CAST(row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) AS INTEGER) AS image_index
    FROM valid JOIN wanted USING (clip_id, track_id, pos)""",
)
def uniform_sample_query(v: Views) -> DataFrame:
    return win.uniform_sample(v.boxes, 10)


def _crops(v: Views, count: int) -> DataFrame:
    sampled = win.uniform_sample(v.boxes, 4 * count, form="ratio")
    return sampled.select(
        "clip_id", "track_id", "frame", (F.col("w") * F.col("h")).alias("area"), F.col("x").alias("sharpness")
    )


@query(
    "quality_binned_sample",
    """WITH valid AS (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS pos,
        count(*) OVER (PARTITION BY clip_id, track_id) AS n
      FROM boxes WHERE track_id LIKE 'player%' AND w > 1 AND h > 1),
    wanted AS (SELECT DISTINCT clip_id, track_id, CASE WHEN n <= 20 THEN i
        ELSE CAST(round_even(i*CAST(n - 1 AS DOUBLE)/19, 0) AS BIGINT) END AS pos
      FROM (SELECT DISTINCT clip_id, track_id, n, unnest(generate_series(0, 19)) AS i FROM valid)),
    crops AS (SELECT clip_id, track_id, frame, w*h AS area, x AS sharpness,
        row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS q,
        count(*) OVER (PARTITION BY clip_id, track_id) AS m
      FROM valid JOIN wanted USING (clip_id, track_id, pos)),
    bins AS (SELECT *, sqrt(greatest(1.0, area))*ln(1 + least(sharpness, 5000.0)) AS quality,
        (SELECT min(b) FROM (SELECT unnest(generate_series(0, 4)) AS b)
          WHERE q >= b*m//least(5, m) AND q < (b + 1)*m//least(5, m)) AS bin FROM crops)
    SELECT clip_id, track_id, CAST(bin AS INTEGER) AS bin, frame, area, sharpness, round(quality, 6) AS quality_score
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id, bin ORDER BY quality DESC, frame) AS r FROM bins)
    WHERE r = 1""",
)
def quality_binned_query(v: Views) -> DataFrame:
    return win.quality_binned_sample(_crops(v, 5), 5).withColumn(
        "quality_score", F.round("quality_score", 6)
    )


_BAG = """CAST(round_even(i*(CAST(greatest(0, n - 22) AS DOUBLE)/3), 0) AS INTEGER)"""


@query(
    "bag_starts",
    f"""SELECT clip_id, track_id, i AS clip_index, {_BAG} AS start,
      (SELECT string_agg(CAST(greatest(0, least(({_BAG}) + j*3, n - 1)) AS VARCHAR), ',' ORDER BY j)
        FROM (SELECT unnest(generate_series(0, 7)) AS j)) AS frames
    FROM (SELECT clip_id, track_id, max(frame) + 1 AS n, unnest(generate_series(0, 3))::INTEGER AS i FROM boxes GROUP BY 1, 2)""",
)
def bag_starts_query(v: Views) -> DataFrame:
    stats = tr.track_statistics(v.boxes)
    stride = win.frame_stride(25.0, 8.0)
    starts = stats.select(
        "clip_id",
        "track_id",
        "n_frames",
        F.posexplode(win.bag_starts(F.col("n_frames"), 8, stride, 4)).alias("clip_index", "start"),
    )
    frames = win.clip_frames(F.col("start"), F.col("n_frames"), 8, stride)
    return starts.select(
        "clip_id", "track_id", "clip_index", "start",
        F.array_join(frames.cast("array<string>"), ",").alias("frames"),
    )


@query(
    "mask_bounds",
    """SELECT 's' || l_suppkey AS clip_id, l_returnflag AS kind, l_linenumber AS object_id, CAST(l_partkey % 40 AS INTEGER) AS frame,
      min(CASE WHEN l_discount > 0.03 THEN l_quantity::INTEGER END) AS x, min(CASE WHEN l_discount > 0.03 THEN l_orderkey % 100 END) AS y,
      max(CASE WHEN l_discount > 0.03 THEN l_quantity::INTEGER END) - min(CASE WHEN l_discount > 0.03 THEN l_quantity::INTEGER END) + 1 AS w,
      max(CASE WHEN l_discount > 0.03 THEN l_orderkey % 100 END) - min(CASE WHEN l_discount > 0.03 THEN l_orderkey % 100 END) + 1 AS h
    FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def mask_bounds_query(v: Views) -> DataFrame:
    pixels = v.table("lineitem").select(
        text("s", F.col("l_suppkey")).alias("clip_id"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linenumber").alias("object_id"),
        (F.col("l_partkey") % 40).cast("int").alias("frame"),
        F.col("l_quantity").cast("int").alias("px"),
        (F.col("l_orderkey") % 100).alias("py"),
        (F.col("l_discount") - 0.03 > 1e-9).cast("int").alias("value"),
    )
    return tr.mask_bounds(pixels)


@query(
    "densify_tracks",
    """WITH b AS (SELECT clip_id, CASE WHEN track_id LIKE 'ball%' THEN 'ball' ELSE 'player' END AS kind,
        CAST(regexp_extract(track_id, '[0-9]+$') AS INTEGER)*3 AS object_id, frame, x, y, w, h FROM boxes),
    o AS (SELECT clip_id, kind, object_id, dense_rank() OVER (PARTITION BY clip_id, kind ORDER BY object_id) AS r
      FROM (SELECT DISTINCT clip_id, kind, object_id FROM b)),
    n AS (SELECT clip_id, max(frame) + 1 AS n FROM b GROUP BY 1),
    g AS (SELECT o.*, unnest(generate_series(0, n - 1))::INTEGER AS frame FROM o JOIN n USING (clip_id))
    SELECT g.clip_id, g.kind || '_' || (g.r - CASE WHEN g.kind = 'player' THEN 1 ELSE 0 END) AS track_id, g.frame, x, y, w, h
    FROM g LEFT JOIN b ON b.clip_id = g.clip_id AND b.kind = g.kind AND b.object_id = g.object_id AND b.frame = g.frame""",
)
def densify_query(v: Views) -> DataFrame:
    boxes = v.boxes.select(
        "clip_id",
        F.when(F.col("track_id").startswith("ball"), "ball").otherwise("player").alias("kind"),
        (F.regexp_extract("track_id", "([0-9]+)$", 1).cast("int") * 3).alias("object_id"),
        "frame", "x", "y", "w", "h",
    )
    return tr.densify_tracks(boxes)


@query(
    "topk_objects",
    """SELECT *, CASE WHEN r <= 4 THEN CAST(r AS INTEGER) END AS rank, r <= 4 AS kept FROM (
      SELECT 'o' || l_suppkey AS session_id, l_returnflag AS prompt, l_partkey*1000000 + l_orderkey*10 + l_linenumber AS pos,
        l_discount AS probability FROM lineitem) JOIN (
      SELECT 'o' || l_suppkey AS session_id, l_returnflag AS prompt, l_partkey*1000000 + l_orderkey*10 + l_linenumber AS pos,
        row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_discount DESC, l_partkey*1000000 + l_orderkey*10 + l_linenumber) AS r
      FROM lineitem) USING (session_id, prompt, pos)""".replace("SELECT *, CASE", "SELECT session_id, prompt, pos, probability, CASE", 1),
)
def topk_objects_query(v: Views) -> DataFrame:
    scores = v.table("lineitem").select(
        text("o", F.col("l_suppkey")).alias("session_id"),
        F.col("l_returnflag").alias("prompt"),
        (F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_discount").alias("probability"),
    )
    return tr.topk_objects(scores, 4)


_STATS = """(SELECT clip_id, track_id, count(*) FILTER (WHERE w > 0 AND h > 0) AS n, max(frame) + 1 AS len FROM boxes GROUP BY 1, 2)"""
_PREPARED = f"""SELECT clip_id, track_id, track_id AS source_track_id, 'unresolved' AS identity_status, n AS valid_bbox_count, len AS n_frames
    FROM {_STATS} WHERE track_id LIKE 'player%' AND n > 0
    UNION ALL SELECT c.clip_id, 'ball', b.track_id, NULL, coalesce(b.n, 0), coalesce(b.len, c.len)
    FROM (SELECT clip_id, max(len) AS len FROM {_STATS} GROUP BY 1) c LEFT JOIN
      (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, track_id DESC) AS r FROM {_STATS} WHERE track_id LIKE 'ball%') b
      ON b.clip_id = c.clip_id AND r = 1"""


@query("prepare_tracks", _PREPARED)
def prepare_tracks_query(v: Views) -> DataFrame:
    return tr.prepare_tracks(v.boxes)


@query(
    "prepared_boxes",
    f"""SELECT p.clip_id, p.track_id, frame, CASE WHEN w > 0 AND h > 0 THEN x END AS x, CASE WHEN w > 0 AND h > 0 THEN y END AS y,
      CASE WHEN w > 0 AND h > 0 THEN w END AS w, CASE WHEN w > 0 AND h > 0 THEN h END AS h
    FROM ({_PREPARED}) p JOIN boxes b ON b.clip_id = p.clip_id AND b.track_id = p.source_track_id""",
)
def prepared_boxes_query(v: Views) -> DataFrame:
    return tr.prepared_boxes(v.boxes, tr.prepare_tracks(v.boxes))


@query(
    "track_report",
    f"""SELECT clip_id, count(*) FILTER (WHERE track_id <> 'ball') AS player_count,
      string_agg(track_id, ',' ORDER BY track_id) FILTER (WHERE track_id <> 'ball') AS player_ids,
      max(CASE WHEN track_id = 'ball' THEN source_track_id END) AS selected_ball_track_id
    FROM ({_PREPARED}) GROUP BY clip_id""",
)
def track_report_query(v: Views) -> DataFrame:
    report = tr.track_report(tr.prepare_tracks(v.boxes))
    return report.withColumn("player_ids", F.array_join("player_ids", ","))


_BALL = """WITH b AS (SELECT *, x + w/2 AS cx, y + h/2 AS cy FROM boxes WHERE track_id LIKE 'ball%' AND w > 1 AND h > 1),
    s AS (SELECT *, sqrt(power(cx - lag(cx) OVER k, 2) + power(cy - lag(cy) OVER k, 2))/(frame - lag(frame) OVER k) AS speed
      FROM b WINDOW k AS (PARTITION BY clip_id, track_id ORDER BY frame)),
    a AS (SELECT clip_id, track_id, count(*) AS n_frames, avg(w) AS mw, avg(h) AS mh, avg(w*h) AS ma, avg(w/greatest(h, 1e-6)) AS aspect,
        sqrt(power(max(cx) - min(cx), 2) + power(max(cy) - min(cy), 2)) AS rng, coalesce(median(speed), 0) AS speed FROM s GROUP BY 1, 2)"""


@query(
    "ball_statistics",
    _BALL + """SELECT clip_id, track_id, n_frames, round(mw, 6) AS mean_width, round(ma, 6) AS mean_area,
      round(rng, 6) AS move_range, round(speed, 6) AS median_speed FROM a""",
)
def ball_statistics_query(v: Views) -> DataFrame:
    return tr.ball_statistics(v.boxes).select(
        "clip_id", "track_id", "n_frames",
        *[F.round(c, 6).alias(c) for c in ("mean_width", "mean_area", "move_range", "median_speed")],
    )


@query(
    "rank_ball_candidates",
    _BALL + """, scored AS (SELECT *, 0.3*(CASE WHEN mw < 6 OR mh < 6 THEN 0.2 ELSE 1 END)*(CASE WHEN mw > 50 OR mh > 50 THEN 0.15 ELSE 1 END)
          *(CASE WHEN ma > 2500 THEN 0.05 ELSE 1 END) + 0.2*least(1, greatest(0, 1.4 - abs(aspect - 1))) + 0.2*least(1, rng/500)
          + 0.2*least(1, speed/10) + 0.1*least(1, n_frames/80) AS score FROM a)
    SELECT clip_id, track_id, round(score, 6) AS heuristic_score,
      CAST(row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 9) DESC, track_id) AS INTEGER) AS rank FROM scored""",
)
def rank_ball_query(v: Views) -> DataFrame:
    return tr.rank_ball_candidates(v.boxes).select(
        "clip_id", "track_id", F.round("heuristic_score", 6).alias("heuristic_score"), "rank"
    )


@query(
    "single_ball_or_none",
    """SELECT DISTINCT b.clip_id, selected_ball_id FROM boxes b LEFT JOIN (SELECT clip_id, min(track_id) AS selected_ball_id FROM boxes
      WHERE track_id LIKE 'ball%' AND w > 1 AND h > 1 GROUP BY clip_id HAVING count(DISTINCT track_id) = 1) s ON s.clip_id = b.clip_id""",
)
def single_ball_query(v: Views) -> DataFrame:
    return tr.single_ball_or_none(v.boxes)


_SEGMENTS = """(SELECT 'c' || s_suppkey AS clip_id, 'player_' || (1 + s_nationkey % 5) AS raw_track_id,
      CASE WHEN s_acctbal < 500 THEN 'ball_1' ELSE 'player_0' END AS output_track_id,
      CAST(s_nationkey*5 AS INTEGER) AS start_frame, CAST(s_nationkey*12 AS INTEGER) AS end_frame FROM supplier)"""


def _segments(v: Views) -> DataFrame:
    nation = F.col("s_nationkey")
    return v.table("supplier").select(
        text("c", F.col("s_suppkey")).alias("clip_id"),
        text("player_", 1 + nation % 5).alias("raw_track_id"),
        F.when(F.col("s_acctbal") < 500, "ball_1").otherwise("player_0").alias("output_track_id"),
        (nation * 5).cast("int").alias("start_frame"),
        (nation * 12).cast("int").alias("end_frame"),
    )


_MASK = f"""WITH j AS (SELECT s.*, b.frame, b.x, b.y, b.w, b.h, coalesce(w > 1 AND h > 1, false) AS valid,
        coalesce(w > 1 AND h > 1, false) AND frame BETWEEN start_frame AND end_frame AS inside
      FROM {_SEGMENTS} s LEFT JOIN boxes b ON b.clip_id = s.clip_id AND b.track_id = s.raw_track_id),
    st AS (SELECT clip_id, raw_track_id, output_track_id, start_frame, end_frame, max(frame) + 1 AS source_trajectory_length,
        count(*) FILTER (WHERE valid) AS source_valid_bbox_count, count(*) FILTER (WHERE inside) AS retained_valid_bbox_count,
        min(CASE WHEN inside THEN frame END) AS first_retained_frame, max(CASE WHEN inside THEN frame END) AS last_retained_frame
      FROM j GROUP BY 1, 2, 3, 4, 5),
    r AS (SELECT *, CASE WHEN output_track_id NOT LIKE 'player%' THEN 'invalid_output_track'
        WHEN source_trajectory_length IS NULL THEN 'missing_track' WHEN end_frame >= source_trajectory_length THEN 'range_exceeds_track'
        WHEN retained_valid_bbox_count = 0 THEN 'no_valid_boxes' ELSE 'ok' END AS status FROM st)"""


@query("mask_segment_audit", _MASK + " SELECT * FROM r")
def mask_audit_query(v: Views) -> DataFrame:
    return tr.mask_segment(v.boxes, _segments(v))[1]


@query(
    "mask_segment",
    _MASK + """ SELECT clip_id, output_track_id AS track_id, frame, CASE WHEN inside THEN x END AS x, CASE WHEN inside THEN y END AS y,
      CASE WHEN inside THEN w END AS w, CASE WHEN inside THEN h END AS h FROM j
    WHERE (clip_id, raw_track_id) IN (SELECT (clip_id, raw_track_id) FROM r WHERE status = 'ok')""",
)
def mask_segment_query(v: Views) -> DataFrame:
    return tr.mask_segment(v.boxes, _segments(v))[0]


def _matches(v: Views) -> DataFrame:
    return tr.match_tracks(v.clean_tracks, v.clean_boxes, v.raw_tracks)


# A plain restatement: walk the clean ids in order, carrying the claimed raw ids.
_CLAIMS = """WITH RECURSIVE cl AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY track_id) AS i
      FROM clean_tracks WHERE track_id LIKE 'player%'),
    cand AS (SELECT cl.clip_id, i, cl.track_id, source_track_id,
        CASE WHEN source_track_id IS NULL THEN 'trajectory_signature' ELSE 'source_track_id' END AS method,
        coalesce(list(r.track_id ORDER BY r.track_id) FILTER (WHERE r.track_id IS NOT NULL), []) AS c
      FROM cl LEFT JOIN raw_tracks r ON r.clip_id = cl.clip_id AND r.track_id LIKE 'player%'
        AND CASE WHEN source_track_id IS NULL THEN r.w = cl.w ELSE r.track_id = source_track_id END GROUP BY ALL),
    walk AS (
      SELECT clip_id, 0::BIGINT AS i, ''::VARCHAR AS track_id, ''::VARCHAR AS method, []::VARCHAR[] AS c, []::VARCHAR[] AS free, []::VARCHAR[] AS claimed
        FROM (SELECT DISTINCT clip_id FROM cand)
      UNION ALL
      SELECT n.clip_id, n.i, n.track_id, n.method, n.c, list_filter(n.c, lambda x: NOT list_contains(w.claimed, x)),
        CASE WHEN len(list_filter(n.c, lambda x: NOT list_contains(w.claimed, x))) = 1
          THEN list_concat(w.claimed, list_filter(n.c, lambda x: NOT list_contains(w.claimed, x))) ELSE w.claimed END
      FROM walk w JOIN cand n ON n.clip_id = w.clip_id AND n.i = w.i + 1),
    matched AS (SELECT clip_id, track_id AS clean_track_id, method, len(c) AS candidate_count,
        CASE WHEN len(free) = 1 THEN 'matched' WHEN len(c) = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status,
        CASE WHEN len(free) = 1 THEN free[1] END AS raw_track_id FROM walk WHERE i > 0)"""


@query("match_tracks", _CLAIMS + " SELECT * FROM matched")
def match_tracks_query(v: Views) -> DataFrame:
    return _matches(v).drop("candidate_group")


@query(
    "match_ball",
    """WITH clips_ AS (SELECT DISTINCT clip_id FROM raw_tracks UNION SELECT clip_id FROM clean_tracks),
    ball AS (SELECT * FROM clean_tracks WHERE track_id = 'ball'),
    same AS (SELECT r.clip_id, count(*) AS n, min(r.track_id) AS raw FROM raw_tracks r JOIN ball b ON b.clip_id = r.clip_id AND b.w = r.w
      WHERE r.track_id LIKE 'ball%' GROUP BY 1)
    SELECT k.clip_id, CASE WHEN b.clip_id IS NULL THEN 'missing_clean_ball' WHEN r.track_id IS NOT NULL OR n = 1 THEN 'matched'
        WHEN n IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS status,
      CASE WHEN b.clip_id IS NULL THEN NULL WHEN r.track_id IS NOT NULL THEN 'source_track_id' ELSE 'trajectory_signature' END AS method,
      coalesce(r.track_id, CASE WHEN n = 1 THEN raw END) AS raw_track_id,
      CASE WHEN r.track_id IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS candidate_count
    FROM clips_ k LEFT JOIN ball b ON b.clip_id = k.clip_id LEFT JOIN raw_tracks r ON r.clip_id = b.clip_id AND r.track_id = b.source_track_id
      LEFT JOIN same s ON s.clip_id = k.clip_id""",
)
def match_ball_query(v: Views) -> DataFrame:
    return tr.match_ball(v.clean_tracks, v.clean_boxes, v.raw_tracks)


@query(
    "selection_audit",
    _CLAIMS + """ SELECT r.clip_id, r.track_id AS raw_track_id, m.clean_track_id IS NOT NULL AS accepted, m.clean_track_id,
      CAST(NULL AS VARCHAR) AS player_name, c.jersey_number, c.jersey_color,
      CASE WHEN m.clean_track_id IS NULL THEN r.track_id || ' | not selected'
        ELSE '#' || c.jersey_number || ' ' || c.jersey_color || ' | ' || r.track_id END AS text
    FROM raw_tracks r LEFT JOIN matched m ON m.clip_id = r.clip_id AND m.raw_track_id = r.track_id AND m.status = 'matched'
      LEFT JOIN clean_tracks c ON c.clip_id = m.clip_id AND c.track_id = m.clean_track_id WHERE r.track_id LIKE 'player%'""",
)
def selection_audit_query(v: Views) -> DataFrame:
    return tr.selection_audit(v.raw_tracks, v.clean_tracks, _matches(v))


@query(
    "selection_summary",
    _CLAIMS + """ SELECT r.clip_id, coalesce(string_agg(r.track_id, ',' ORDER BY r.track_id) FILTER (WHERE m.clip_id IS NOT NULL), '') AS selected,
      coalesce(string_agg(r.track_id, ',' ORDER BY r.track_id) FILTER (WHERE m.clip_id IS NULL), '') AS not_selected
    FROM raw_tracks r LEFT JOIN matched m ON m.clip_id = r.clip_id AND m.raw_track_id = r.track_id AND m.status = 'matched'
    WHERE r.track_id LIKE 'player%' GROUP BY 1""",
)
def selection_summary_query(v: Views) -> DataFrame:
    audit = tr.selection_audit(v.raw_tracks, v.clean_tracks, _matches(v))
    return tr.selection_summary(audit).select(
        "clip_id",
        F.array_join("selected_raw_tracks", ",").alias("selected"),
        F.array_join("raw_player_tracks_not_selected", ",").alias("not_selected"),
    )


def _kept_frames(v: Views) -> DataFrame:
    """Eight frames per clip at a fixed stride; some lie beyond the tracks."""
    return v.table("supplier").select(
        text("c", F.col("s_suppkey")).alias("clip_id"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 40 + F.col("s_nationkey") - 3)
        ).alias("out_index", "frame"),
    )


_KEPT = """(SELECT 'c' || s_suppkey AS clip_id, i AS out_index, CAST(i*40 + s_nationkey - 3 AS INTEGER) AS frame
      FROM (SELECT *, unnest(generate_series(0, 7))::INTEGER AS i FROM supplier))"""
_LENGTHS = "(SELECT clip_id, track_id, max(frame) + 1 AS n FROM boxes GROUP BY 1, 2)"


@query(
    "project_boxes_clamped",
    f"""SELECT t.clip_id, t.track_id, out_index, coalesce(x*0.5, 0) AS b0, coalesce(y*2, 0) AS b1,
      coalesce(x*0.5 + w*0.5, 0) AS b2, coalesce(y*2 + h*2, 0) AS b3, CASE WHEN x IS NULL THEN 0 ELSE 1 END::DOUBLE AS valid
    FROM {_KEPT} k JOIN {_LENGTHS} t USING (clip_id)
    LEFT JOIN boxes b ON b.clip_id = t.clip_id AND b.track_id = t.track_id AND b.frame = greatest(0, least(k.frame, n - 1))""",
)
def project_clamped_query(v: Views) -> DataFrame:
    return tr.project_boxes(_kept_frames(v), tr.track_statistics(v.boxes), v.boxes, 0.5, 2.0, "clamp")


@query(
    "project_boxes_masked",
    f"""SELECT t.clip_id, t.track_id, out_index, coalesce(x*0.5, 0) AS b0, coalesce(y*2, 0) AS b1,
      coalesce(w*0.5, 0) AS b2, coalesce(h*2, 0) AS b3, CASE WHEN x IS NULL THEN 0 ELSE 1 END::DOUBLE AS valid
    FROM {_KEPT} k JOIN {_LENGTHS} t USING (clip_id)
    LEFT JOIN boxes b ON b.clip_id = t.clip_id AND b.track_id = t.track_id AND b.frame = k.frame""",
)
def project_masked_query(v: Views) -> DataFrame:
    return tr.project_boxes(
        _kept_frames(v), tr.track_statistics(v.boxes), v.boxes, 0.5, 2.0, "null", corners=False
    )


def _references(v: Views) -> DataFrame:
    """Two overlapping windows of 60 s per supplier, as references of one event."""
    offsets = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return (
        v.table("supplier")
        .select(text("c", F.col("s_suppkey")).alias("window_id"), F.expr("s_suppkey div 2").alias("e"), "s_suppkey", offsets.alias("o"))
        .select(
            text("e", F.col("e")).alias("event_id"),
            (F.col("s_suppkey") * 3 + F.col("o")).cast("int").alias("ref_pos"),
            "window_id",
            text("player_", F.col("o") + 1).alias("track_id"),
            ((F.col("s_suppkey") % 2) * 25 + F.col("e") * 10).cast("double").alias("window_start"),
            ((F.col("s_suppkey") % 2) * 25 + F.col("e") * 10 + 60).cast("double").alias("window_end"),
            F.lit(240).alias("n_frames"),
        )
    )


_REFS = """(SELECT 'e' || (s_suppkey // 2) AS event_id, s_suppkey*3 + o AS ref_pos, 'c' || s_suppkey AS window_id, 'player_' || (o + 1) AS track_id,
      CAST((s_suppkey % 2)*25 + (s_suppkey // 2)*10 AS DOUBLE) AS ws, CAST((s_suppkey % 2)*25 + (s_suppkey // 2)*10 + 60 AS DOUBLE) AS we
      FROM (SELECT *, unnest([0, 1, 2]) AS o FROM supplier))"""
_MATERIALS = """(SELECT 'm' || e AS material_id, 'e' || e AS event_id, CAST(e*10 - 5 AS DOUBLE) AS ms, CAST(e*10 + 95 AS DOUBLE) AS me
      FROM (SELECT DISTINCT s_suppkey // 2 AS e FROM supplier))"""
_AT = f"""WITH times AS (SELECT material_id, event_id, ms + i/CAST(2 AS DOUBLE) AS t FROM (SELECT *, unnest(generate_series(0, 199)) AS i FROM {_MATERIALS})),
    hits AS (SELECT k.material_id, k.event_id, k.t, window_id || '/' || r.track_id AS reference,
        CAST(greatest(0, least(239, floor((t - ws)/(we - ws)*240))) AS INTEGER) AS frame, least(t - ws, we - t) AS margin, ref_pos, window_id, r.track_id
      FROM times k JOIN {_REFS} r ON r.event_id = k.event_id AND t >= ws AND t <= we),
    best AS (SELECT * FROM (SELECT h.*, x, y, w, b.h AS bh, row_number() OVER (PARTITION BY event_id, t ORDER BY margin DESC, ref_pos) AS r
      FROM hits h JOIN boxes b ON b.clip_id = h.window_id AND b.track_id = h.track_id AND b.frame = h.frame AND w > 0 AND b.h > 0) WHERE r = 1)"""


def _materials(v: Views) -> DataFrame:
    event = F.col("e")
    return v.table("supplier").select(F.expr("s_suppkey div 2").alias("e")).distinct().select(
        text("m", event).alias("material_id"),
        text("e", event).alias("event_id"),
        (event * 10 - 5).cast("double").alias("start_seconds"),
        (event * 10 + 95).cast("double").alias("end_seconds"),
    )


@query(
    "bbox_at_time",
    _AT + """ SELECT k.event_id, k.t, reference, frame, x, y, w, bh AS h FROM times k LEFT JOIN best b ON b.event_id = k.event_id AND b.t = k.t""",
)
def bbox_at_time_query(v: Views) -> DataFrame:
    grid = tr.time_grid(_materials(v), 2.0)
    return tr.bbox_at_time(grid, _references(v), v.boxes, 60.0)


@query(
    "actor_coverage",
    _AT + """ SELECT k.material_id, count(*) AS frame_count, count(b.reference) AS actor_bbox_frame_count
    FROM times k LEFT JOIN best b ON b.event_id = k.event_id AND b.t = k.t GROUP BY 1""",
)
def actor_coverage_query(v: Views) -> DataFrame:
    return tr.actor_coverage(_materials(v), _references(v), v.boxes, 2.0, 60.0)


@query(
    "spread_positions",
    """SELECT p_partkey, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT DISTINCT p_partkey,
        CASE WHEN p_size <= 6 THEN i ELSE CAST(round_even(i*(CAST(p_size - 1 AS DOUBLE)/5), 0) AS BIGINT) END AS pos, p_size
      FROM (SELECT *, unnest(generate_series(0, 5)) AS i FROM part)) WHERE pos < p_size GROUP BY 1""",
)
def spread_positions_query(v: Views) -> DataFrame:
    return v.table("part").select(
        "p_partkey",
        F.array_join(spread_positions(F.col("p_size"), 6).cast("array<string>"), ",").alias("positions"),
    )


@query(
    "valid_box_variants",
    """SELECT clip_id, track_id, count(*) FILTER (WHERE w > 0 AND h > 0) AS model_input, count(*) FILTER (WHERE w > 1 AND h > 1) AS sampling,
      count(*) FILTER (WHERE w > 1 AND h > 1) AS finite, count(*) FILTER (WHERE w > 0 AND h > 0 AND x > 20) AS castable,
      count(*) FILTER (WHERE x IS NOT NULL AND h > 3) AS complete FROM boxes GROUP BY 1, 2""",
)
def valid_boxes_query(v: Views) -> DataFrame:
    width, height = F.col("w"), F.col("h")
    shown = F.when(F.col("x") > 20, F.col("x").cast("string")).otherwise("left")
    texts = F.array(shown, *[F.col(c).cast("string") for c in "ywh"])
    numbers = F.when(height > 3, F.array(*[F.col(c) for c in "xywh"])).otherwise(F.array("x", "y"))
    return v.boxes.groupBy("clip_id", "track_id").agg(
        F.count_if(is_box(width, height)).alias("model_input"),
        F.count_if(is_box(width, height, 1.0)).alias("sampling"),
        F.count_if(is_finite_box(F.col("x"), F.col("y"), width, height, 1.0)).alias("finite"),
        F.count_if(castable_box(texts).isNotNull()).alias("castable"),
        F.count_if(box_array(numbers).isNotNull()).alias("complete"),
    )


@query(
    "scorable_clips",
    f"""SELECT clip_id, n AS player_count, CASE WHEN n > 0 THEN 'completed' ELSE 'completed_with_warning' END AS status,
      CASE WHEN n > 0 THEN 'run' ELSE 'skipped' END AS scoring
    FROM (SELECT clip_id, count(*) FILTER (WHERE track_id <> 'ball') AS n FROM ({_PREPARED}) GROUP BY 1)""",
)
def scorable_clips_query(v: Views) -> DataFrame:
    from clipledger.operators.incremental import scorable_clips

    return scorable_clips(tr.track_report(tr.prepare_tracks(v.boxes)))
