"""Domain tables derived from the driver's tables, in Spark and in SQL.

Every view is a deterministic mapping of whole tables (integer time units,
``CASE``, integer division), so both engines derive the same rows. Minutes since
2024-01-01 play the part of seconds.
"""

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.operators.catalog import Catalog
from clipledger.operators.windows import assign_windows, plan_windows

WINDOW, OVERLAP, TAIL = 720.0, 120.0, 200.0
STEP = WINDOW - OVERLAP
GAP = 0.5
CLASSES = 11
SCORE_FPS, SCORE_FRAMES = 10.0, 505


def text(*parts: Column | str) -> Column:
    """Concatenate literals and columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def choose(column: Column, mapping: dict, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value).cast("string")).otherwise(out)
    return out


def game_name(index: Column) -> Column:
    return F.format_string("t%d-vs-u%d-%010d", index % 7, index % 5, index)


EVENT_TYPES = {
    "error": "blank",
    "click": "Missed Shot",
    "view": "Rebound",
    "purchase": "Made Shot",
    "signup": "ast",
}
FLAG_COLORS = {"A": "white", "N": "black", "R": "red"}
FLAG_EVENTS = {"A": "Made Shot", "N": "Foul", "R": "Rebound"}
LINE_ACTIONS = {
    1: "2PT Shot",
    2: "3pt  shot",
    3: "Rebound",
    4: "Foul",
    5: "Free Throw",
    6: "steal",
    7: "Violation",
}


class Views:
    """Driver tables of one scale factor and the domain tables made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------- timeline

    @cached_property
    def evidence(self) -> DataFrame:
        minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)")
        return self.table("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            text("v", F.expr("user_id div 10")).alias("video_id"),
            minute.cast("double").alias("t"),
            (10 + F.col("event_id") % 50).cast("double").alias("len"),
            choose(F.col("event_type"), EVENT_TYPES).alias("event"),
            text("player_", F.col("user_id") % 10).alias("track"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        )

    @cached_property
    def videos(self) -> DataFrame:
        ids = self.table("events").select(F.expr("user_id div 10").alias("vid")).distinct()
        duration = (43200 + 37 * (F.col("vid") % 11)).cast("double")
        return ids.select(
            text("v", F.col("vid")).alias("video_id"),
            duration.alias("duration_seconds"),
            F.lit(2.5).alias("fps"),
            F.ceil(duration * 2.5).cast("bigint").alias("frame_count"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        return plan_windows(self.videos, WINDOW, OVERLAP, TAIL)

    @cached_property
    def claims(self) -> DataFrame:
        placed = assign_windows(self.evidence, self.videos, "t", WINDOW, OVERLAP, TAIL)
        return placed.select(
            "window_id",
            F.col("event_id").alias("pos"),
            F.col("track").alias("source_track_id"),
            F.lit(None).cast("string").alias("player_id"),
            F.when(F.col("event") == "ast", text("g", F.col("user_id"))).alias("global_track_id"),
            "event",
            "confidence",
            F.when(F.col("event") != "Rebound", F.col("confidence") / 2).alias("temporal_score"),
            F.col("local_seconds").alias("start_time"),
            (F.col("local_seconds") + F.col("len")).alias("end_time"),
        )

    # --------------------------------------------------------------- tracks

    @cached_property
    def boxes(self) -> DataFrame:
        line = F.col("l_linenumber")
        hidden = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")

        def shown(value: Column) -> Column:
            return F.max(F.when(~hidden, value))

        return (
            self.table("lineitem")
            .groupBy(
                text("c", F.col("l_suppkey")).alias("clip_id"),
                F.when(line <= 5, text("player_", line)).otherwise(text("ball_", line)).alias("track_id"),
                (F.col("l_partkey") % 240).cast("int").alias("frame"),
            )
            .agg(
                shown(F.col("l_quantity") * 10).alias("x"),
                shown(F.col("l_tax") * 1000).alias("y"),
                shown(F.col("l_discount") * 200 - 2).alias("w"),
                shown(F.col("l_quantity") / 2).alias("h"),
            )
        )

    @cached_property
    def raw_tracks(self) -> DataFrame:
        """Raw tracks of short clips; some trajectories are exact copies."""
        line = F.col("l_linenumber")
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.max(F.ceil(F.col("l_quantity") / 25) + 1).cast("double").alias("w")
        )
        return rows.select(
            text("o", F.col("l_orderkey")).alias("clip_id"),
            F.when(line <= 5, text("player_", line)).otherwise(text("ball_", line)).alias("track_id"),
            F.lit(0).alias("frame"),
            F.lit(1.0).alias("x"),
            F.lit(2.0).alias("y"),
            "w",
            F.lit(4.0).alias("h"),
        )

    @cached_property
    def clean_tracks(self) -> DataFrame:
        """Clean tracks: a copy of each raw one, some naming their source."""
        line = F.col("l_linenumber")
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_discount").alias("d"),
            F.max(F.ceil(F.col("l_quantity") / 25) + 1).cast("double").alias("w"),
            F.min("l_returnflag").alias("flag"),
            F.min(F.col("l_suppkey") % 12).alias("number"),
        )
        name = F.when(line <= 5, text("player_", line)).when(line == 6, F.lit("ball"))
        source = F.when(line <= 5, text("player_", line)).otherwise(text("ball_", line))
        return rows.filter(name.isNotNull()).select(
            text("o", F.col("l_orderkey")).alias("clip_id"),
            name.alias("track_id"),
            F.when(F.col("d") > 0.05, source).alias("source_track_id"),
            F.lit(None).cast("string").alias("player_name"),
            F.col("number").cast("string").alias("jersey_number"),
            choose(F.col("flag"), FLAG_COLORS).alias("jersey_color"),
            "w",
        )

    @cached_property
    def clean_boxes(self) -> DataFrame:
        return self.clean_tracks.select(
            "clip_id",
            "track_id",
            F.lit(0).alias("frame"),
            F.lit(1.0).alias("x"),
            F.lit(2.0).alias("y"),
            "w",
            F.lit(4.0).alias("h"),
        )

    # --------------------------------------------------------------- scores

    @cached_property
    def clips(self) -> DataFrame:
        vector = F.transform("embedding", lambda v: v.cast("double"))
        index = (F.col("vec_id") % 50).cast("int")
        return self.table("embeddings").select(
            text("e", F.expr("vec_id div 50")).alias("video_id"),
            text("player_", F.col("label")).alias("person_id"),
            index.alias("clip_index"),
            F.transform(F.slice(vector, 1, CLASSES), lambda v: v * 10).alias("logits"),
            F.abs(F.get(vector, F.lit(CLASSES))).alias("gate"),
            F.abs(F.get(vector, F.lit(CLASSES))).alias("score"),
            (F.get(vector, F.lit(CLASSES + 1)) > -0.1).alias("valid"),
            vector.alias("features"),
            F.array(index * 10, index * 10 + 7, index * 10 + 19).alias("frames"),
            "label",
        )

    @cached_property
    def persons(self) -> DataFrame:
        return self.clips.groupBy("video_id", "person_id").agg(
            F.min_by("logits", "clip_index").alias("logits"),
            F.max("valid").alias("valid"),
            F.min(F.when(F.col("label") == 9, 0).otherwise(F.col("label"))).cast("int").alias("label"),
        )

    @cached_property
    def score_videos(self) -> DataFrame:
        return self.clips.select("video_id").distinct().select(
            "video_id", F.lit(SCORE_FPS).alias("fps"), F.lit(SCORE_FRAMES).alias("total_frames")
        )

    # ------------------------------------------------------------- identity

    @cached_property
    def observations(self) -> DataFrame:
        line, flag = F.col("l_linenumber"), F.col("l_returnflag")
        frame = (F.col("l_partkey") * 7 + line).cast("int")
        color = F.when(F.col("l_quantity") >= 10, choose(flag, FLAG_COLORS))
        return self.table("lineitem").select(
            text("o", F.col("l_orderkey")).alias("track_ref"),
            frame.alias("pos"),
            frame.alias("frame_index"),
            F.when(line <= 5, True).when(line == 6, False).alias("is_on_court_player"),
            color.alias("jersey_color"),
            choose(F.col("l_suppkey") % 3, {0: "0", 1: "00", 2: "13"}).alias("jersey_number"),
            (F.col("l_discount") * 10).alias("confidence"),
        )

    @cached_property
    def identity_tracks(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            text("o", key).alias("track_ref"),
            text("Game ", F.col("o_custkey") % 25).alias("game"),
            text("Clip ", F.expr("o_orderkey div 7")).alias("clip_id"),
            text("player_", key % 7).alias("track_id"),
        )

    @cached_property
    def roster(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            text("Game ", key % 25).alias("game"),
            choose(key % 3, {0: " White", 1: "black", 2: "red"}).alias("color"),
            choose(F.expr("s_suppkey div 25") % 3, {0: "0", 1: "00", 2: "13"}).alias("jersey"),
            F.col("s_name").alias("name"),
        )

    # -------------------------------------------------------------- catalog

    @cached_property
    def catalog(self) -> Catalog:
        line = self.table("lineitem")
        stamp = F.lit("2024-01-01 00:00:00")
        return Catalog(
            participants=self.table("supplier").select(
                text("p", F.col("s_suppkey")).alias("participant_id"),
                F.col("s_name").alias("display_name"),
                choose(F.col("s_suppkey") % 3, {0: "white", 1: "black", 2: "red"}).alias("jersey_color"),
                (F.col("s_nationkey").cast("string")).alias("jersey_number"),
                F.lit("{}").alias("metadata_json"),
                stamp.alias("created_at"),
                stamp.alias("updated_at"),
            ),
            materials=self.table("orders").select(
                text("m", F.col("o_orderkey")).alias("material_id"),
                text("v", F.expr("o_custkey div 10")).alias("source_video_id"),
                text("s", F.col("o_orderkey")).alias("segment_id"),
                text("media/", F.col("o_orderkey"), ".mp4").alias("video_path"),
                (F.col("o_totalprice") / 1000).alias("start_seconds"),
                (F.col("o_totalprice") / 1000 + 12).alias("end_seconds"),
                F.lit("ready").alias("processing_status"),
                F.lit("{}").alias("metadata_json"),
            ),
            material_events=line.select(
                text("m", F.col("l_orderkey")).alias("material_id"),
                (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("event_seq"),
                choose(F.col("l_returnflag"), FLAG_EVENTS).alias("event_name"),
                (F.col("l_discount") * 10).alias("confidence"),
                text("player_", F.col("l_linenumber")).alias("player_id"),
                text("p", F.col("l_suppkey")).alias("participant_id"),
                F.when(F.col("l_linestatus") == "F", "identified").otherwise("anonymous").alias("identity_status"),
                F.col("l_quantity").alias("start_seconds"),
                (F.col("l_quantity") + 2).alias("end_seconds"),
            ),
            material_participants=line.groupBy(
                text("m", F.col("l_orderkey")).alias("material_id"),
                text("p", F.col("l_suppkey")).alias("participant_id"),
                text("player_", F.col("l_linenumber")).alias("track_id"),
            ).agg(
                F.min(choose(F.col("l_returnflag"), FLAG_COLORS)).alias("jersey_color"),
                F.lit(None).cast("string").alias("jersey_number"),
                F.lit(None).cast("string").alias("player_name"),
                F.lit("identified").alias("identity_status"),
            ),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Prediction rows per material (one report per order)."""
        line = F.col("l_linenumber")
        return self.table("lineitem").select(
            text("m", F.col("l_orderkey")).alias("material_id"),
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("pos"),
            text("player_", line).alias("player_id"),
            F.when(F.col("l_tax") < 0.03, text("p", F.col("l_suppkey"))).alias("participant_id"),
            F.when(F.col("l_quantity") > 5, choose(F.col("l_returnflag"), {"A": "White", "N": "black", "R": ""})).alias("jersey_color"),
            F.when(F.col("l_discount") > 0.02, (F.col("l_suppkey") % 12).cast("string")).alias("jersey_number"),
            F.lit(None).cast("string").alias("player_name"),
            F.when(F.col("l_linestatus") == "F", "identified").alias("identity_status"),
            F.when(line == 7, F.lit(None)).when(line == 6, "blank").otherwise(choose(F.col("l_returnflag"), FLAG_EVENTS)).alias("event"),
            F.when(F.col("l_tax") > 0, F.col("l_discount") * 10).alias("confidence"),
        )

    @cached_property
    def temporal(self) -> DataFrame:
        """Temporal events per material; many materials have none."""
        line = F.col("l_linenumber")
        return self.table("lineitem").filter("l_quantity > 40").select(
            text("m", F.col("l_orderkey")).alias("material_id"),
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("pos"),
            text("player_", line).alias("player_id"),
            F.lit(None).cast("string").alias("participant_id"),
            F.lit(None).cast("string").alias("identity_status"),
            F.when(line == 6, "blank").otherwise(choose(F.col("l_returnflag"), FLAG_EVENTS)).alias("event"),
            (F.col("l_discount") * 10).alias("confidence"),
            F.col("l_quantity").alias("start_time"),
            (F.col("l_quantity") + 3).alias("end_time"),
        )

    # ------------------------------------------------------------- labelling

    @cached_property
    def actions(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self.table("lineitem").select(
            text("o", F.col("l_orderkey")).alias("clip_id"),
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + line).alias("action_index"),
            F.when(F.col("l_tax") == 0.08, F.lit("x1")).otherwise((F.col("l_suppkey") % 12).cast("string")).alias("player"),
            choose(F.col("l_returnflag"), FLAG_COLORS).alias("color"),
            choose(line, LINE_ACTIONS).alias("action"),
            F.when(F.col("l_quantity") <= 45, F.col("l_linestatus") == "F").alias("result"),
            (F.col("l_discount") > 0.07).alias("assisted"),
            F.when(F.col("l_tax") != 0.07, (F.col("l_partkey") % 12).cast("string")).alias("other_player"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """One action document per order; some lack a list or misstate its size."""
        counts = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count(F.lit(1)).alias("n")
        )
        joined = self.table("orders").join(counts, "o_orderkey", "left")
        count = F.coalesce("n", F.lit(0).cast("bigint"))
        return joined.select(
            text("o", F.col("o_orderkey")).alias("clip_id"),
            (count + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)).alias("numerosity"),
            F.when(F.col("o_totalprice") > 5000, count).alias("action_count"),
        )

    @cached_property
    def label_tracks(self) -> DataFrame:
        """Tracks of each clip for labelling: up to seven players and often a ball."""
        line = F.col("l_linenumber")
        players = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min(choose(F.col("l_returnflag"), FLAG_COLORS)).alias("jersey_color"),
            F.min(F.col("l_suppkey") % 12).cast("string").alias("number"),
            F.max("l_quantity").cast("int").alias("n_frames"),
            F.min("l_tax").alias("tax"),
        )
        players = players.select(
            text("o", F.col("l_orderkey")).alias("clip_id"),
            text("player_", line).alias("track_id"),
            F.lit(True).alias("is_object"),
            F.when(F.col("n_frames") > 2, F.col("n_frames")).alias("n_frames"),
            "jersey_color",
            F.when(F.col("tax") < 0.08, F.col("number")).alias("jersey_number"),
        )
        balls = self.table("orders").filter("o_orderpriority <> '5-LOW'").select(
            text("o", F.col("o_orderkey")).alias("clip_id"),
            F.lit("ball").alias("track_id"),
            F.lit(True).alias("is_object"),
            F.lit(30).alias("n_frames"),
            F.lit(None).cast("string").alias("jersey_color"),
            F.lit(None).cast("string").alias("jersey_number"),
        )
        return players.unionByName(balls)

    @cached_property
    def game_orders(self) -> DataFrame:
        """Orders as clips of games."""
        index = F.expr("o_custkey div 50")
        return self.table("orders").select("*", index.alias("gi"), game_name(index).alias("game"))

    @cached_property
    def games(self) -> DataFrame:
        """Each game once, with its number and highest price; orders are grouped by number, so a game is named once."""
        tops = self.table("orders").groupBy(F.expr("o_custkey div 50").alias("gi")).agg(F.max("o_totalprice").alias("top"))
        return tops.select(game_name(F.col("gi")).alias("game"), "gi", "top")

    @cached_property
    def files(self) -> DataFrame:
        """A file listing of all games, with gaps."""
        orders = self.game_orders
        stem = F.col("o_orderkey").cast("string")

        def kind(condition: str, folder: str, suffix: str) -> DataFrame:
            return orders.filter(condition).select(
                F.concat("game", F.lit(f"/{folder}/"), stem, F.lit(f".{suffix}")).alias("path")
            )

        rosters = orders.groupBy("game").agg(F.max("o_totalprice").alias("top")).filter(
            "top < 499500"
        ).select(F.concat("game", F.lit("/description/players/roster.json")).alias("path"))
        out = kind("true", "video", "mp4")
        for condition, folder, suffix in (
            ("o_orderstatus <> 'P'", "description/PBP", "json"),
            ("o_orderpriority <> '1-URGENT'", "description/action", "json"),
            ("o_orderpriority <> '5-LOW'", "description/GT caption", "txt"),
            ("o_orderstatus = 'F'", "label", "json"),
        ):
            out = out.unionByName(kind(condition, folder, suffix))
        return out.unionByName(rosters)

    # ------------------------------------------------------------ evaluation

    @cached_property
    def _evaluated(self) -> DataFrame:
        week = F.floor(F.col("t") / 10080).cast("int")
        value = F.floor("value").cast("int")
        actor = F.when(F.col("value") >= 5, text("p", value % 4))
        return self.evidence.select(
            text("s", F.col("user_id"), "_", week).alias("sample_id"),
            text("g", F.expr("user_id div 30")).alias("game"),
            "event_id",
            "value",
            F.when(F.col("event") == "blank", "Foul").otherwise(F.col("event")).alias("event"),
            actor.alias("actor"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self._evaluated.select("sample_id", "game").distinct()

    @cached_property
    def references(self) -> DataFrame:
        return self._evaluated.select("sample_id", F.col("event_id").alias("pos"), "actor", "event")

    @cached_property
    def predicted(self) -> DataFrame:
        value, shuffled = F.col("value"), F.col("event_id") * 10 + (F.col("event_id") % 3) * 25
        return self._evaluated.select(
            "sample_id",
            shuffled.alias("pos"),
            F.when(value < 40, F.col("actor")).when(value <= 200, F.lit("p0")).alias("actor"),
            F.when(value < 60, F.col("event")).when(value > 300, "blank").otherwise("Turnover").alias("event"),
            (value / 500).alias("confidence"),
        )

    @cached_property
    def targets(self) -> DataFrame:
        """Reference ranges with the range predicted for them, if any."""
        length = (10 + F.col("event_id") % 50).cast("double")
        found = F.col("value") > 10
        start = F.col("t")
        return self.evidence.select(
            F.col("event").alias("ref_event"),
            start.alias("ref_start"),
            (start + length).alias("ref_end"),
            F.when(found, F.when(F.col("value") > 150, "Foul").otherwise(F.col("event"))).alias("pred_event"),
            F.when(found, start + F.floor("value") % 20).alias("pred_start"),
            F.when(found, start + F.floor("value") % 20 + 15).alias("pred_end"),
        )

    @cached_property
    def product_identities(self) -> DataFrame:
        value = F.col("value")
        return self.evidence.filter("value > 20").select(
            text("e", F.col("event_id")).alias("event_id"),
            F.when(value < 150, "identified").otherwise("conflicting").alias("status"),
            F.when(value < 120, " White").alias("jersey_color"),
            (F.floor(value) % 30).cast("string").alias("jersey_number"),
        )

    @cached_property
    def timed_events(self) -> DataFrame:
        return self.evidence.select(
            text("e", F.col("event_id")).alias("event_id"),
            F.col("video_id").alias("source_video_id"),
            "event",
            "confidence",
            F.col("t").alias("evidence_start_seconds"),
            (F.col("t") + F.col("len")).alias("evidence_end_seconds"),
        )


def _case(column: str, mapping: dict) -> str:
    quoted = {k: (f"'{k}'" if isinstance(k, str) else k) for k in mapping}
    return f"CASE {column} " + " ".join(f"WHEN {quoted[k]} THEN '{v}'" for k, v in mapping.items()) + " END"


_SEQ = "l_partkey*1000000 + l_suppkey*10 + l_linenumber"
_COLOR = _case("l_returnflag", FLAG_COLORS)
_EVENT = _case("l_returnflag", FLAG_EVENTS)
_TRACK = "CASE WHEN l_linenumber <= 5 THEN 'player_' ELSE 'ball_' END || l_linenumber"
_HIDDEN = "CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O') THEN {} END"

VIEW_SQL = {
    "evidence": f"""
        SELECT event_id, user_id, event_type, value, 'v' || (user_id // 10) AS video_id,
          CAST(date_diff('minute', TIMESTAMP '2024-01-01', ts) AS DOUBLE) AS t,
          CAST(10 + event_id % 50 AS DOUBLE) AS len, {_case('event_type', EVENT_TYPES)} AS event,
          'player_' || (user_id % 10) AS track, least(value / 100, 1.0) AS confidence
        FROM events""",
    "videos": """
        SELECT 'v' || vid AS video_id, CAST(43200 + 37*(vid % 11) AS DOUBLE) AS duration_seconds,
          CAST(2.5 AS DOUBLE) AS fps, CAST(ceil((43200 + 37*(vid % 11))*2.5) AS BIGINT) AS frame_count
        FROM (SELECT DISTINCT user_id // 10 AS vid FROM events)""",
    "raw_windows": """
        SELECT v.*, k, CAST(k*600 AS DOUBLE) AS s, least(CAST(k*600 + 720 AS DOUBLE), duration_seconds) AS e
        FROM (SELECT *, unnest(generate_series(0, CAST(floor(duration_seconds/600) AS BIGINT))) AS k FROM videos) v
        WHERE k*600 < duration_seconds AND (k = 0 OR (k-1)*600 + 720 < duration_seconds)""",
    "last_windows": """
        SELECT video_id, max(k) AS mk, max(k) > 0 AND max(duration_seconds) - max(k)*600 < 200 AS joined
        FROM raw_windows GROUP BY video_id""",
    "windows": """
        SELECT printf('%s_%05d', r.video_id, k) AS segment_id, r.video_id AS source_video_id,
          CAST(k AS INTEGER) AS index, s AS start_seconds,
          CASE WHEN joined AND k = mk - 1 THEN duration_seconds ELSE e END AS end_seconds,
          least(CAST(round_even(s*fps, 0) AS BIGINT), frame_count) AS source_start_frame,
          CASE WHEN joined AND k = mk - 1 THEN frame_count
               ELSE least(CAST(round_even(e*fps, 0) AS BIGINT), frame_count) END AS source_end_frame
        FROM raw_windows r JOIN last_windows l ON r.video_id = l.video_id
        WHERE NOT (joined AND k = mk)""",
    "claims": """
        SELECT w.segment_id AS window_id, w.source_video_id, w.start_seconds AS ws, w.end_seconds - w.start_seconds AS wl,
          event_id AS pos, track AS source_track_id,
          CASE WHEN event = 'ast' THEN 'g' || user_id END AS global_track_id, event, confidence,
          CASE WHEN event <> 'Rebound' THEN confidence/2 END AS temporal_score,
          t - w.start_seconds AS start_time, t - w.start_seconds + len AS end_time
        FROM evidence e JOIN windows w ON e.video_id = w.source_video_id
          AND e.t >= w.start_seconds AND e.t < w.end_seconds""",
    "candidates": """
        SELECT printf('%s:event_%04d', window_id, pos) AS candidate_id, source_video_id, window_id,
          source_track_id AS local_track_id, global_track_id, event, confidence,
          CASE WHEN temporal_score IS NULL OR temporal_score = 0 THEN confidence ELSE temporal_score END AS temporal_score,
          greatest(0.0, start_time) AS local_start_seconds, least(wl, end_time) AS local_end_seconds,
          ws + greatest(0.0, start_time) AS global_start_seconds, ws + least(wl, end_time) AS global_end_seconds
        FROM claims WHERE event <> 'blank'""",
    "opened": """
        SELECT *, CASE WHEN global_start_seconds <= max(global_end_seconds) OVER w + 0.5 THEN 0 ELSE 1 END AS opens
        FROM candidates WINDOW w AS (PARTITION BY source_video_id, event
          ORDER BY global_start_seconds, event, window_id, local_track_id, candidate_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "islands": """
        SELECT *, sum(opens) OVER (PARTITION BY source_video_id, event
          ORDER BY global_start_seconds, event, window_id, local_track_id, candidate_id) AS island
        FROM opened""",
    "island_events": """
        SELECT *, CAST(row_number() OVER (PARTITION BY source_video_id
            ORDER BY start, event, window_id, local_track_id, first_candidate) - 1 AS BIGINT) AS event_index
        FROM (SELECT source_video_id, event, max(confidence) AS confidence, max(temporal_score) AS temporal_score,
            max(global_track_id) AS global_track_id,
            min(global_start_seconds) AS start, max(global_end_seconds) AS end_,
            arg_min(window_id, (global_start_seconds, window_id, local_track_id, candidate_id)) AS window_id,
            arg_min(local_track_id, (global_start_seconds, window_id, local_track_id, candidate_id)) AS local_track_id,
            arg_min(candidate_id, (global_start_seconds, window_id, local_track_id, candidate_id)) AS first_candidate,
            string_agg(candidate_id, ',' ORDER BY global_start_seconds, window_id, local_track_id, candidate_id) AS candidate_ids,
            string_agg(window_id || '/' || local_track_id, ',' ORDER BY global_start_seconds, window_id, local_track_id, candidate_id) AS track_references
          FROM islands GROUP BY source_video_id, event, island)""",
    "ordered_candidates": """
        SELECT *, row_number() OVER (PARTITION BY source_video_id, event
          ORDER BY global_start_seconds, window_id, local_track_id, candidate_id) AS i FROM candidates""",
    # The merge rule walked candidate by candidate; the state lists the groups
    # that can still be joined: name, reach, window=track entries, known person.
    "greedy_walk": """
        SELECT source_video_id, event, 0::BIGINT AS i, ''::VARCHAR AS grp,
          []::STRUCT(n VARCHAR, r DOUBLE, w VARCHAR[], k VARCHAR)[] AS gs
        FROM (SELECT DISTINCT source_video_id, event FROM ordered_candidates)
        UNION ALL
        SELECT source_video_id, event, i, coalesce(hit.n, candidate_id),
          CASE WHEN hit IS NULL THEN list_append(open, {'n': candidate_id, 'r': e, 'w': [wt], 'k': known})
          ELSE list_transform(open, lambda g: CASE WHEN g.n = hit.n
            THEN {'n': g.n, 'r': greatest(g.r, e), 'w': list_append(g.w, wt), 'k': coalesce(g.k, known)} ELSE g END) END
        FROM (SELECT *, list_last(list_filter(open, lambda g: len(list_filter(g.w, lambda x: starts_with(x, win) AND x <> wt)) = 0
            AND (known IS NULL OR g.k IS NULL OR g.k = known))) AS hit
          FROM (SELECT c.source_video_id, c.event, c.i, c.candidate_id, c.global_end_seconds AS e, c.global_track_id AS known,
              c.window_id || '=' AS win, c.window_id || '=' || c.local_track_id AS wt,
              list_filter(w.gs, lambda g: c.global_start_seconds <= g.r + 0.5) AS open
            FROM greedy_walk w JOIN ordered_candidates c ON c.source_video_id = w.source_video_id AND c.event = w.event AND c.i = w.i + 1))""",
    "exact_events": """
        SELECT *, CAST(row_number() OVER (PARTITION BY source_video_id
            ORDER BY start, event, window_id, local_track_id, first_candidate) - 1 AS BIGINT) AS event_index
        FROM (SELECT source_video_id, event, max(confidence) AS confidence, max(temporal_score) AS temporal_score,
            max(global_track_id) AS global_track_id,
            min(global_start_seconds) AS start, max(global_end_seconds) AS end_,
            arg_min(window_id, i) AS window_id, arg_min(local_track_id, i) AS local_track_id,
            arg_min(candidate_id, i) AS first_candidate, string_agg(candidate_id, ',' ORDER BY i) AS candidate_ids,
            string_agg(window_id || '/' || local_track_id, ',' ORDER BY i) AS track_references
          FROM ordered_candidates JOIN greedy_walk USING (source_video_id, event, i)
          GROUP BY source_video_id, event, grp)""",
    "boxes": f"""
        SELECT 'c' || l_suppkey AS clip_id, {_TRACK} AS track_id, CAST(l_partkey % 240 AS INTEGER) AS frame,
          max({_HIDDEN.format('l_quantity*10')}) AS x, max({_HIDDEN.format('l_tax*1000')}) AS y,
          max({_HIDDEN.format('l_discount*200 - 2')}) AS w, max({_HIDDEN.format('l_quantity/2')}) AS h
        FROM lineitem GROUP BY ALL""",
    "raw_tracks": f"""
        SELECT 'o' || l_orderkey AS clip_id, {_TRACK} AS track_id,
          CAST(max(ceil(l_quantity/25) + 1) AS DOUBLE) AS w FROM lineitem GROUP BY ALL""",
    "clean_tracks": f"""
        SELECT 'o' || l_orderkey AS clip_id,
          CASE WHEN l_linenumber <= 5 THEN 'player_' || l_linenumber ELSE 'ball' END AS track_id,
          CASE WHEN min(l_discount) > 0.05 THEN {_TRACK} END AS source_track_id,
          CAST(min(l_suppkey % 12) AS VARCHAR) AS jersey_number,
          {_case('min(l_returnflag)', FLAG_COLORS)} AS jersey_color,
          CAST(max(ceil(l_quantity/25) + 1) AS DOUBLE) AS w
        FROM lineitem WHERE l_linenumber <= 6 GROUP BY l_orderkey, l_linenumber""",
    "clips": """
        SELECT 'e' || (vec_id // 50) AS video_id, 'player_' || label AS person_id,
          CAST(vec_id % 50 AS INTEGER) AS clip_index,
          list_transform(embedding[1:11], lambda v: CAST(v AS DOUBLE)*10) AS logits,
          abs(CAST(embedding[12] AS DOUBLE)) AS gate, CAST(embedding[13] AS DOUBLE) > -0.1 AS valid,
          list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS features, label
        FROM embeddings""",
    "persons": """
        SELECT video_id, person_id, arg_min(logits, clip_index) AS logits, bool_or(valid) AS valid,
          min(CASE WHEN label = 9 THEN 0 ELSE label END) AS label
        FROM clips GROUP BY video_id, person_id""",
    "person_probabilities": """
        SELECT video_id, person_id, label, valid, list_transform(l, lambda v: v / list_sum(l)) AS p
        FROM (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS l FROM persons)""",
    "clip_probabilities": """
        SELECT *, list_transform(l, lambda v: v / list_sum(l)) AS p
        FROM (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS l FROM clips)""",
    "observations": f"""
        SELECT 'o' || l_orderkey AS track_ref, CAST(l_partkey*7 + l_linenumber AS INTEGER) AS frame_index,
          CASE WHEN l_linenumber <= 5 THEN true WHEN l_linenumber = 6 THEN false END AS is_on_court_player,
          CASE WHEN l_quantity >= 10 THEN {_COLOR} END AS jersey_color,
          {_case('l_suppkey % 3', {0: '0', 1: '00', 2: '13'})} AS jersey_number, l_discount*10 AS confidence
        FROM lineitem""",
    "identity_tracks": """
        SELECT 'o' || o_orderkey AS track_ref, 'Game ' || (o_custkey % 25) AS game,
          'Clip ' || (o_orderkey // 7) AS clip_id, 'player_' || (o_orderkey % 7) AS track_id FROM orders""",
    "roster": f"""
        SELECT 'Game ' || (s_suppkey % 25) AS game, {_case('s_suppkey % 3', {0: ' White', 1: 'black', 2: 'red'})} AS color,
          {_case('(s_suppkey // 25) % 3', {0: '0', 1: '00', 2: '13'})} AS jersey, s_name AS name FROM supplier""",
    "materials": """
        SELECT 'm' || o_orderkey AS material_id, 'v' || (o_custkey // 10) AS source_video_id,
          's' || o_orderkey AS segment_id, 'media/' || o_orderkey || '.mp4' AS video_path,
          o_totalprice/1000 AS start_seconds, o_totalprice/1000 + 12 AS end_seconds FROM orders""",
    "material_events": f"""
        SELECT 'm' || l_orderkey AS material_id, {_SEQ} AS event_seq, {_EVENT} AS event_name,
          l_discount*10 AS confidence, 'player_' || l_linenumber AS player_id, 'p' || l_suppkey AS participant_id,
          CASE WHEN l_linestatus = 'F' THEN 'identified' ELSE 'anonymous' END AS identity_status,
          l_quantity AS start_seconds FROM lineitem""",
    "material_participants": f"""
        SELECT 'm' || l_orderkey AS material_id, 'p' || l_suppkey AS participant_id,
          'player_' || l_linenumber AS track_id, min({_COLOR}) AS jersey_color FROM lineitem GROUP BY ALL""",
    "participants": f"""
        SELECT 'p' || s_suppkey AS participant_id, s_name AS display_name,
          {_case('s_suppkey % 3', {0: 'white', 1: 'black', 2: 'red'})} AS jersey_color,
          CAST(s_nationkey AS VARCHAR) AS jersey_number FROM supplier""",
    "predictions": f"""
        SELECT 'm' || l_orderkey AS material_id, {_SEQ} AS pos, 'player_' || l_linenumber AS player_id,
          CASE WHEN l_tax < 0.03 THEN 'p' || l_suppkey END AS participant_id,
          CASE WHEN l_quantity > 5 THEN {_case('l_returnflag', {'A': 'White', 'N': 'black', 'R': ''})} END AS jersey_color,
          CASE WHEN l_discount > 0.02 THEN CAST(l_suppkey % 12 AS VARCHAR) END AS jersey_number,
          CASE WHEN l_linestatus = 'F' THEN 'identified' END AS identity_status,
          CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'blank' ELSE {_EVENT} END AS event,
          CASE WHEN l_tax > 0 THEN l_discount*10 END AS confidence FROM lineitem""",
    "temporal": f"""
        SELECT 'm' || l_orderkey AS material_id, {_SEQ} AS pos, 'player_' || l_linenumber AS player_id,
          CASE WHEN l_linenumber = 6 THEN 'blank' ELSE {_EVENT} END AS event,
          l_discount*10 AS confidence, l_quantity AS start_time, l_quantity + 3 AS end_time
        FROM lineitem WHERE l_quantity > 40""",
    "actions": f"""
        SELECT 'o' || l_orderkey AS clip_id, {_SEQ} AS action_index,
          CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_suppkey % 12 AS VARCHAR) END AS player, {_COLOR} AS color,
          l_linenumber AS kind, {_case('l_linenumber', LINE_ACTIONS)} AS action,
          CASE WHEN l_quantity <= 45 THEN l_linestatus = 'F' END AS result, l_discount > 0.07 AS assisted,
          CASE WHEN l_tax <> 0.07 THEN CAST(l_partkey % 12 AS VARCHAR) END AS other_player FROM lineitem""",
    "mapped": """
        SELECT *, CASE WHEN player IS NULL THEN NULL
            WHEN kind <= 2 THEN CASE WHEN result THEN 'Made Shot' WHEN NOT result THEN 'Missed Shot' END
            WHEN kind <= 6 THEN action END AS label
        FROM actions""",
    "contributions": """
        SELECT clip_id, color AS jersey_color, player AS jersey_number, label, action_index AS source_action_index,
          'primary_actor' AS role FROM mapped WHERE label IS NOT NULL
        UNION ALL
        SELECT clip_id, color, other_player, 'ast', action_index, 'assistant' FROM mapped
        WHERE kind <= 2 AND label IS NOT NULL AND assisted AND other_player IS NOT NULL""",
    "documents_": """
        SELECT 'o' || o_orderkey AS clip_id,
          coalesce(n, 0) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS numerosity,
          CASE WHEN o_totalprice > 5000 THEN coalesce(n, 0) END AS action_count
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "actors": """
        SELECT clip_id, jersey_color, jersey_number, count(*) AS n, count(DISTINCT label) AS labels,
          arg_min(label, (source_action_index, role = 'assistant')) AS label,
          arg_min(source_action_index, (source_action_index, role = 'assistant')) AS source_action_index,
          arg_min(role, (source_action_index, role = 'assistant')) AS role
        FROM contributions GROUP BY 1, 2, 3""",
    "mapping_codes": """
        SELECT clip_id AS scope_id, 'INVALID_ACTION_IDENTITY' AS code, 'error' AS severity FROM mapped WHERE player IS NULL
        UNION ALL SELECT clip_id, 'MISSING_SHOT_RESULT', 'error' FROM mapped WHERE player IS NOT NULL AND kind <= 2 AND result IS NULL
        UNION ALL SELECT clip_id, 'UNMAPPED_ACTION', 'error' FROM mapped WHERE player IS NOT NULL AND kind = 7
        UNION ALL SELECT clip_id, 'MISSING_ASSISTANT_IDENTITY', 'error' FROM mapped
          WHERE kind <= 2 AND label IS NOT NULL AND assisted AND other_player IS NULL
        UNION ALL SELECT clip_id, 'INVALID_ACTION_DOCUMENT', 'error' FROM documents_ WHERE action_count IS NULL
        UNION ALL SELECT clip_id, 'NUMEROSITY_MISMATCH', 'error' FROM documents_ WHERE numerosity <> action_count
        UNION ALL SELECT clip_id, 'NO_STRUCTURED_ACTION', 'error' FROM documents_ WHERE action_count = 0
        UNION ALL SELECT clip_id, 'MULTI_LABEL_ACTOR', 'error' FROM actors WHERE labels > 1
        UNION ALL SELECT clip_id, 'DUPLICATE_LABEL_COLLAPSED', 'warning' FROM actors WHERE labels = 1 AND n > 1""",
    "label_tracks": f"""
        SELECT 'o' || l_orderkey AS clip_id, 'player_' || l_linenumber AS track_id,
          CASE WHEN max(l_quantity) > 2 THEN CAST(max(l_quantity) AS INTEGER) END AS n_frames,
          min({_COLOR}) AS jersey_color,
          CASE WHEN min(l_tax) < 0.08 THEN min(l_suppkey % 12)::VARCHAR END AS jersey_number
        FROM lineitem GROUP BY l_orderkey, l_linenumber
        UNION ALL SELECT 'o' || o_orderkey, 'ball', 30, NULL, NULL FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "resolved_tracks": """
        SELECT * FROM label_tracks WHERE track_id <> 'ball' AND n_frames IS NOT NULL
          AND jersey_color IS NOT NULL AND jersey_number IS NOT NULL""",
    "track_actors": """
        SELECT clip_id, jersey_color, jersey_number, count(*) AS tracks, min(track_id) AS track_id
        FROM resolved_tracks GROUP BY 1, 2, 3""",
    "label_codes": """
        SELECT * FROM mapping_codes
        UNION ALL SELECT clip_id, 'MISSING_PLAYER_TRAJECTORY', 'warning' FROM label_tracks WHERE track_id <> 'ball' AND n_frames IS NULL
        UNION ALL SELECT clip_id, 'UNRESOLVED_TRACK_IDENTITY', 'warning' FROM label_tracks
          WHERE track_id <> 'ball' AND n_frames IS NOT NULL AND (jersey_color IS NULL OR jersey_number IS NULL)
        UNION ALL SELECT clip_id, 'AMBIGUOUS_TRACK_IDENTITY', 'error' FROM track_actors WHERE tracks > 1
        UNION ALL SELECT a.clip_id, 'UNMATCHED_GT_ACTOR', 'error' FROM actors a WHERE labels = 1 AND NOT EXISTS (
          SELECT 1 FROM track_actors t WHERE t.clip_id = a.clip_id AND t.jersey_color = a.jersey_color AND t.jersey_number = a.jersey_number)
        UNION ALL SELECT 'o' || o_orderkey, 'MISSING_BALL_TRACK', 'error' FROM orders WHERE o_orderpriority = '5-LOW'""",
    "verdicts": """
        SELECT 'o' || o_orderkey AS clip_id, CASE WHEN 'o' || o_orderkey IN
          (SELECT scope_id FROM label_codes WHERE severity = 'error') THEN 'excluded' ELSE 'accepted' END AS status
        FROM orders""",
    "game_orders": """
        SELECT *, o_custkey // 50 AS gi,
          printf('t%d-vs-u%d-%010d', (o_custkey // 50) % 7, (o_custkey // 50) % 5, o_custkey // 50) AS game FROM orders""",
    "roster_games": "SELECT game FROM game_orders GROUP BY game HAVING max(o_totalprice) < 499500",
    "manifest": """
        SELECT o.game AS game, right(o.game, 10) AS game_id, CAST(o_orderkey AS VARCHAR) AS video_name,
          'video/' || o_orderkey || '.mp4' AS video,
          CASE WHEN o_orderstatus <> 'P' THEN 'description/PBP/' || o_orderkey || '.json' END AS pbp,
          CASE WHEN o_orderpriority <> '1-URGENT' THEN 'description/action/' || o_orderkey || '.json' END AS action,
          CASE WHEN o_orderpriority <> '5-LOW' THEN 'description/GT caption/' || o_orderkey || '.txt' END AS gt_caption,
          CASE WHEN o.game IN (SELECT game FROM roster_games) THEN 'description/players/roster.json' END AS roster,
          CASE WHEN o_orderstatus = 'F' THEN 'label/' || o_orderkey || '.json' END AS annotation
        FROM game_orders o""",
    "splits": """
        SELECT game, CASE WHEN pos < n - v - t THEN 'train' WHEN pos < n - t THEN 'valid' ELSE 'test' END AS split, pos
        FROM (SELECT game, CAST(row_number() OVER (ORDER BY sha256('7|' || game)) - 1 AS BIGINT) AS pos, n,
            greatest(1, CAST(round_even(n*CAST(0.7 AS DOUBLE)*0 + n*CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS v,
            greatest(1, CAST(round_even(n*(1 - CAST(0.7 AS DOUBLE) - CAST(0.15 AS DOUBLE)), 0) AS BIGINT)) AS t
          FROM (SELECT DISTINCT game FROM game_orders), (SELECT count(DISTINCT game) AS n FROM game_orders))""",
    "evaluated": """
        SELECT 's' || user_id || '_' || CAST(floor(t/10080) AS INTEGER) AS sample_id, 'g' || (user_id // 30) AS game,
          event_id, value, CASE WHEN event = 'blank' THEN 'Foul' ELSE event END AS event,
          CASE WHEN value >= 5 THEN 'p' || (CAST(floor(value) AS INTEGER) % 4) END AS actor FROM evidence""",
    "references_": "SELECT sample_id, game, event_id AS pos, actor, event FROM evaluated",
    "predicted": """
        SELECT sample_id, game, event_id*10 + (event_id % 3)*25 AS pos,
          CASE WHEN value < 40 THEN actor WHEN value <= 200 THEN 'p0' END AS actor,
          CASE WHEN value < 60 THEN event WHEN value > 300 THEN 'blank' ELSE 'Turnover' END AS event,
          value/500 AS confidence FROM evaluated""",
    "event_labels": """
        SELECT unnest(['Missed Shot','Made Shot','Free Throw','Foul','Turnover','Jump Ball','Rebound','steal','block','ast']) AS event""",
    "pair_counts": """
        SELECT game, event, sum(r*p) AS matches, sum(p) AS predicted, sum(r) AS reference FROM (
          SELECT game, sample_id, actor, event, max(r) AS r, max(p) AS p FROM (
            SELECT game, sample_id, actor, event, 1 AS r, 0 AS p, 0 AS u FROM references_ WHERE actor IS NOT NULL
            UNION ALL SELECT game, sample_id, actor, event, 0, 1, 0 FROM predicted WHERE actor IS NOT NULL
            UNION ALL SELECT game, sample_id, NULL, event, 1, 0, pos FROM references_ WHERE actor IS NULL
            UNION ALL SELECT game, sample_id, NULL, event, 0, 1, -pos - 1 FROM predicted WHERE actor IS NULL
          ) WHERE event <> 'blank' GROUP BY game, sample_id, actor, event, u) GROUP BY game, event""",
    "targets": """
        SELECT event AS ref_event, t AS rs, t + len AS re,
          CASE WHEN value > 10 THEN CASE WHEN value > 150 THEN 'Foul' ELSE event END END AS pred_event,
          CASE WHEN value > 10 THEN t + CAST(floor(value) AS BIGINT) % 20 END AS ps,
          CASE WHEN value > 10 THEN t + CAST(floor(value) AS BIGINT) % 20 + 15 END AS pe FROM evidence""",
}


def oracle(select: str) -> str:
    """A SELECT with the views it mentions as CTEs, in order."""
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit_body(name)

    def visit_body(name: str) -> None:
        body = VIEW_SQL[name]
        for other in VIEW_SQL:
            if other != name and other not in needed and re.search(rf"\b{other}\b", body):
                visit_body(other)
        needed[name] = None

    visit(select)
    if not needed:
        return select
    views = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    # A query with CTEs of its own gets the views in front of them.
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", select)
    recursive = "RECURSIVE " if "greedy_walk" in needed or (own and own.group(1)) else ""
    if own:
        return f"WITH {recursive}{views},\n{select[own.end():]}"
    return f"WITH {recursive}{views}\n{select}"
