"""Reading JSON documents: tracks, prediction reports, identity reports."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRACK = (
    "trajectory array<string>, source_track_id string, jersey_color string, jersey_number string, "
    "player_name string, participant_id string, identity_status string"
)

_PREDICTION = """
    player_id string, participant_id string, source_track_id string, jersey_color string,
    jersey_number string, player_name string, identity_status string, label_id int, event string,
    confidence double, class_probabilities map<string, double>,
    paper_gate_segment struct<clip_index: int, gate_weight: double, start_time: double, end_time: double>
"""

_EVENT = """
    player_id string, participant_id string, source_track_id string, global_track_id string,
    identity_status string, event string, confidence double, temporal_score double,
    start_time double, end_time double
"""


def _members(text: str) -> Column:
    """The members of a JSON object as texts; NULL for anything else."""
    # valid JSON that begins with a brace is an object
    whole = F.col(text).rlike(r"^\x{FEFF}?\s*\{") & F.try_parse_json(text).isNotNull()
    return F.when(whole, F.from_json(text, "map<string, string>"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _whole_documents(
    spark: SparkSession, path: str | list[str], name: Callable[[Column], Column]
) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return texts.select(
        name(F.col("_metadata.file_path")).alias("clip_id"),
        F.col("_metadata.file_path").alias("path"),
        "value",
    )


def _packed_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    line = F.col("value")
    return spark.read.text(path).select(
        F.substring_index(line, "\t", 1).alias("clip_id"),
        F.col("_metadata.file_path").alias("path"),
        F.when(line.contains("\t"), F.substring(line, F.instr(line, "\t") + 1, F.length(line))).alias("value"),
    )


def read_tracks(
    spark: SparkSession, path: str | list[str], name: Callable[[Column], Column] = file_stem, packed: bool = False
) -> dict[str, DataFrame]:
    """Track documents with one key per track, as tables.

    ``name`` derives the clip id from the file path. With ``packed`` a file holds many
    documents, each on a line after its clip id and a tab: hundreds of thousands of small
    files cost more to create and list than to read.

    Returns ``tracks`` (one row per key), ``boxes`` (one row per frame, NULL box
    where absent or malformed) and ``bad_files`` (root is not an object). Keys
    are data, hence a MAP; tracks and frame entries stay text until their own
    row, so an odd track costs itself (``is_object`` is false) and an odd entry
    its own box.
    """
    documents = _packed_documents(spark, path) if packed else _whole_documents(spark, path, name)
    parsed = documents.select("clip_id", "path", _members("value").alias("tracks"))
    # An outer explode, as Spark would read each document a second time to leave empty ones out before.
    rows = parsed.select("clip_id", F.explode_outer("tracks").alias("track_id", "raw")).filter(
        "track_id IS NOT NULL"
    ).select("clip_id", "track_id", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", _TRACK)).alias("t"))
    tracks = rows.select(
        "clip_id",
        "track_id",
        F.col("t").isNotNull().alias("is_object"),
        F.when(F.col("t.trajectory").isNotNull(), F.size("t.trajectory")).alias("n_frames"),
        *[
            F.col(f"t.{c}").alias(c)
            for c in (
                "source_track_id", "jersey_color", "jersey_number",
                "player_name", "participant_id", "identity_status",
            )
        ],
    )
    frames = rows.select(
        "clip_id", "track_id", F.posexplode_outer("t.trajectory").alias("frame", "entry")
    ).filter("frame IS NOT NULL")
    # Numbers only: quoted text and true/false are not coordinates.
    numeric = F.when(
        F.col("entry").rlike(r"^\s*\[[-+0-9.eE,\s]*\]\s*$"), F.from_json("entry", "array<double>")
    )
    boxes = frames.withColumn("b", numeric).select(
        "clip_id",
        "track_id",
        "frame",
        *[F.when(F.size("b") == 4, F.get("b", F.lit(i))).alias(c) for i, c in enumerate("xywh")],
    )
    bad = parsed.filter("tracks IS NULL").select("clip_id", "path")
    return {"tracks": tracks, "boxes": boxes, "bad_files": bad}


def read_reports(
    spark: SparkSession, paths: str | list[str], name: Callable[[Column], Column] = file_stem, packed: bool = False
) -> dict[str, DataFrame]:
    """Prediction reports as tables; files that are no object, or whose lists are none, apart.

    With ``packed`` a file holds many reports, each on a line after its window id and a tab.

    Returns ``reports``, ``player_predictions``, ``temporal_events`` and
    ``bad_files``. List order is kept in ``pos``. Each list entry is read on its
    own row: a mistyped field is NULL there and costs nothing else.
    """
    documents = _packed_documents(spark, paths) if packed else _whole_documents(spark, paths, name)
    raw = documents.select(
        F.col("clip_id").alias("window_id"), "path", _members("value").alias("m")
    )
    lists = {"player_predictions": _PREDICTION, "temporal_events": _EVENT}
    fit = F.col("m").isNotNull()
    for column in lists:
        fit &= F.coalesce(F.ltrim(F.col("m")[column]).startswith("["), F.lit(True))
    raw = raw.withColumn("fit", fit)
    good = raw.filter("fit")

    def rows(column: str) -> DataFrame:
        # NULL for unfit documents, and an outer explode: a filter would read each document a second time
        entries = F.when(F.col("fit"), F.from_json(F.col("m")[column], "array<string>"))
        return raw.select("window_id", F.posexplode_outer(entries).alias("pos", "raw")).filter("pos IS NOT NULL").select(
            "window_id", "pos", F.from_json("raw", lists[column]).alias("r")
        ).select("window_id", "pos", "r.*")

    return {
        "reports": good.select("window_id", "path", F.col("m")["duration_seconds"].try_cast("double").alias("duration_seconds")),
        "player_predictions": rows("player_predictions"),
        "temporal_events": rows("temporal_events"),
        "bad_files": raw.filter("NOT fit").select("window_id", "path"),
    }


def identity_index(index: DataFrame, reports: DataFrame, base: str) -> DataFrame:
    """Reports of an index from material id to report path.

    ``index`` has a map column ``reports``; relative paths start at ``base``.
    ``reports`` has ``path`` and the report's columns. A missing report keeps
    its row.
    """
    entries = index.select(F.explode("reports").alias("material_id", "report_path"))
    absolute = F.when(F.col("report_path").startswith("/"), F.col("report_path")).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), "report_path")
    )
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return entries.withColumn("path", absolute).join(
        reports.withColumn("path", plain), "path", "left"
    )
