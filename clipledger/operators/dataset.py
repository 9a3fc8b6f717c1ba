"""Dataset preparation over file listings: manifests, games, splits, exports.

A file listing has one row per file with a relative ``path`` such as
``<game>/video/<clip>.mp4``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.text import game_id
from clipledger.operators.guards import stop_unless
from clipledger.operators.prefix import with_position
from clipledger.operators.windows import bag_starts
from clipledger.vocabulary import LABELS, SPLITS

# Manifest field and the folder and suffix of its file.
CLIP_FILES = {
    "video": ("video", "mp4"),
    "pbp": ("description/PBP", "json"),
    "action": ("description/action", "json"),
    "gt_caption": ("description/GT caption", "txt"),
    "annotation": ("label", "json"),
}
ROSTER_FILE = "description/players/roster.json"
RELATED = ["pbp", "action", "gt_caption", "roster", "annotation"]


def _parts(files: DataFrame) -> DataFrame:
    """Split paths into game, folder, stem and suffix."""
    pattern = r"^([^/]+)/(?:(.*)/)?([^/]+)\.([^./]+)$"
    return files.select(
        "path",
        *[
            F.regexp_extract("path", pattern, i).alias(name)
            for i, name in enumerate(("game", "folder", "stem", "suffix"), start=1)
        ],
    ).filter("game <> ''")


def clip_manifest(files: DataFrame) -> DataFrame:
    """One row per video with the paths of its related files, NULL where absent.

    All kinds are folded in one aggregate per (game, clip); the roster, one per
    game, is joined.
    """
    parts = _parts(files)

    def pick(folder: str, suffix: str) -> Column:
        hit = (F.col("folder") == folder) & (F.col("suffix") == suffix)
        relative = F.concat_ws("/", "folder", F.concat_ws(".", "stem", "suffix"))
        return F.max(F.when(hit, relative))

    clips = parts.groupBy("game", "stem").agg(
        *[pick(*where).alias(field) for field, where in CLIP_FILES.items()]
    ).filter("video IS NOT NULL")
    rosters = parts.filter(F.col("path").endswith("/" + ROSTER_FILE)).filter(
        F.col("path") == F.concat_ws("/", "game", F.lit(ROSTER_FILE))
    ).select("game", F.lit(ROSTER_FILE).alias("roster"))
    return clips.join(rosters, "game", "left").select(
        "game",
        game_id(F.col("game")).alias("game_id"),
        F.col("stem").alias("video_name"),
        "video",
        *RELATED,
    )


def manifest_gaps(manifest: DataFrame) -> DataFrame:
    """Clip count and missing related files per game."""
    return manifest.groupBy("game").agg(
        F.count(F.lit(1)).alias("clips"),
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in RELATED],
    )


def discover_games(files: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Games with both a video and a description folder; unknown requests apart."""
    parts = _parts(files).select("game", F.regexp_extract("folder", "^[^/]+", 0).alias("top"))
    found = parts.groupBy("game").agg(
        F.max((F.col("top") == "video").cast("int")).alias("v"),
        F.max((F.col("top") == "description").cast("int")).alias("d"),
    ).filter("v = 1 AND d = 1").select("game")
    if requested is None:
        return found, found.filter(F.lit(False))
    wanted = requested.select("game").distinct()
    return wanted.join(found, "game", "left_semi"), wanted.join(found, "game", "left_anti")


def annotated_games(games: DataFrame, annotations: DataFrame) -> DataFrame:
    """Games with at least one accepted annotation."""
    return games.join(annotations.select("game"), "game", "left_semi")


def select_games(
    games: DataFrame, requested: list[str] | None = None, all_games: bool = False, limit: int = 2
) -> DataFrame:
    """An explicit list in its order, all games, or the first ones by name."""
    names = games.select("game").distinct()
    if requested:
        order = {name: i for i, name in reversed(list(enumerate(requested)))}
        spark = games.sparkSession
        wanted = spark.createDataFrame(list(order.items()), "game string, pos int")
        joined = wanted.join(names.withColumn("__found", F.lit(True)), "game", "left")
        known = stop_unless(joined, F.col("__found"), F.concat(F.lit("unknown game: "), "game"))
        return known.orderBy("pos").select("game")
    if all_games:
        return names.orderBy("game")
    if limit <= 0:
        raise ValueError("limit must be positive")
    return names.orderBy("game").limit(limit)


def _split_counts(games: Column, train_ratio: float, valid_ratio: float) -> tuple[Column, Column]:
    """Number of training and validation games for a number of games."""
    one = F.lit(1).cast("bigint")
    valid = F.greatest(one, F.rint(games * valid_ratio).cast("bigint"))
    test = F.greatest(one, F.rint(games * (1 - train_ratio - valid_ratio)).cast("bigint"))
    train = games - valid - test
    # Too few games: one trains, and the larger of the others gives one up.
    short = train < 1
    valid_fixed = F.when(short & (valid >= test) & (valid > 1), valid - 1).otherwise(valid)
    train_fixed = F.greatest(train, one)
    small_train = F.when(games <= 2, one).otherwise(train_fixed)
    small_valid = F.when(games <= 2, F.lit(0).cast("bigint")).otherwise(valid_fixed)
    return small_train, small_valid


def split_games(games: DataFrame, train_ratio: float, valid_ratio: float, seed: int) -> DataFrame:
    """Assign whole games to train, valid or test in a seeded hash order.

    The hash is uniform, so its first digits are balanced buckets for the
    distributed numbering.
    """
    if train_ratio <= 0 or valid_ratio < 0 or train_ratio + valid_ratio >= 1:
        raise ValueError("ratios must satisfy train > 0, valid >= 0, train + valid < 1")
    hashed = games.select("game").distinct().withColumn(
        "order_hash", F.sha2(F.concat_ws("|", F.lit(str(seed)), "game"), 256)
    )
    placed = with_position(
        hashed.withColumn("__all", F.lit(0)),
        ["__all"],
        [F.col("order_hash"), F.col("game")],
        F.substring("order_hash", 1, 3),
        name="pos",
        total="n",
    )
    train, valid = _split_counts(F.col("n"), train_ratio, valid_ratio)
    split = (
        F.when(F.col("pos") < train, "train")
        .when(F.col("pos") < train + valid, "valid")
        .otherwise("test")
    )
    return placed.select("game", split.alias("split"), "pos")


def validate_split(
    document: DataFrame, staged: DataFrame
) -> DataFrame:
    """Problems of split configurations with array columns train, valid, test."""
    absent = document.select(
        F.explode(
            F.filter(
                F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in SPLITS]),
                lambda s: s.isNotNull(),
            )
        ).alias("game")
    ).select(F.lit("missing_split").alias("problem"), "game")
    rows = document.select(
        F.explode(F.concat(*[F.coalesce(F.col(s), F.array().cast("array<string>")) for s in SPLITS])).alias("game")
    )
    repeated = rows.groupBy("game").count().filter("count > 1").select(
        F.lit("game_in_several_splits").alias("problem"), "game"
    )
    unstaged = rows.distinct().join(staged.select("game"), "game", "left_anti").select(
        F.lit("game_not_staged").alias("problem"), "game"
    )
    return absent.unionByName(repeated).unionByName(unstaged)


def export_runtime(
    splits: DataFrame, videos: DataFrame, annotations: DataFrame
) -> dict[str, DataFrame]:
    """Manifest of the exported clips, per-split totals and blocking problems.

    ``splits`` has ``split, game``; ``videos`` and ``annotations`` have ``game,
    video_name``.
    """
    games = splits.select("split", "game", game_id(F.col("game")).alias("game_id"))
    joined = games.join(
        videos.select("game", "video_name"), "game"
    ).join(
        annotations.select("game", "video_name", F.lit(True).alias("__ok")),
        ["game", "video_name"],
        "left",
    )
    ok = F.coalesce("__ok", F.lit(False))
    path = F.concat_ws("/", F.lit("videos"), "game_id", F.concat("video_name", F.lit(".mp4")))
    target = F.concat_ws("/", "split", "game_id", F.concat("video_name", F.lit(".json")))
    manifest = joined.select(
        F.when(ok, "exported").otherwise("skipped_missing_annotation").alias("status"),
        "split",
        "game",
        "game_id",
        "video_name",
        F.when(ok, path).alias("video"),
        F.when(ok, target).alias("annotation"),
    )
    per_split = games.groupBy("split").agg(F.count(F.lit(1)).alias("games"))
    clip_counts = manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if(F.col("status") != "exported").alias("missing_annotations"),
    )
    summary = per_split.join(clip_counts, "split", "left").na.fill(0)
    shared = games.groupBy("game_id").agg(
        F.min("game").alias("a"), F.max("game").alias("b")
    ).filter("a <> b").select(F.lit("shared_game_id").alias("problem"), F.col("game_id").alias("item"))
    empty = games.join(
        videos.select("game"), "game", "left_anti"
    ).select(F.lit("no_videos").alias("problem"), F.col("game").alias("item"))
    return {"manifest": manifest, "summary": summary, "problems": shared.unionByName(empty)}


def training_index(
    tracks: DataFrame,
    clip_len: int,
    stride: int,
    clips: int,
    add_blank: bool = True,
    require_ball: bool = True,
) -> DataFrame:
    """Clips usable for training, their labelled tracks and clip starts.

    ``tracks`` has ``clip_id, pos, track_id, n_frames`` (NULL without a
    trajectory) and ``action_type``. The first track's length counts.
    """
    ids = F.array(*[F.lit(name) for name in LABELS])
    is_ball = F.col("track_id") == "ball"
    usable = ~is_ball & F.col("n_frames").isNotNull()
    known = F.array_position(ids, F.col("action_type")) - 1
    label = F.when(F.col("action_type").isNull(), F.lit(0) if add_blank else F.lit(None)).otherwise(
        F.when(known >= 0, known)
    ).cast("int")
    labelled = usable & label.isNotNull()
    grouped = tracks.groupBy("clip_id").agg(
        F.max((is_ball & F.col("n_frames").isNotNull()).cast("int")).alias("has_ball"),
        F.min_by(
            F.when(usable, F.col("n_frames")), F.when(usable, F.col("pos"))
        ).alias("nums"),
        F.array_sort(
            F.collect_list(F.when(labelled, F.struct("pos", "track_id", label.alias("label"))))
        ).alias("events"),
    )
    kept = grouped.filter("nums > 0 AND size(events) > 0")
    if require_ball:
        kept = kept.filter("has_ball = 1")
    return kept.select(
        "clip_id",
        F.col("nums").cast("int").alias("nums"),
        F.transform("events", lambda e: F.struct(e["track_id"].alias("track_id"), e["label"].alias("label"))).alias("events"),
        bag_starts(F.col("nums"), clip_len, stride, clips).alias("starts"),
    )


def prepare_summary(expected: DataFrame, files: DataFrame, allow_partial: bool = True) -> DataFrame:
    """Expected, available and missing clips per game.

    ``expected`` has ``game, video_key``; ``files`` the listed ``path`` of the
    raw mirror (``game/clip.mp4``) or the staged form (``game/video/clip.mp4``).
    """
    staged = F.regexp_replace("path", r"/video/([^/]+)$", "/$1")
    present = files.select(staged.alias("video_key")).distinct().withColumn("__ok", F.lit(True))
    joined = expected.join(present, "video_key", "left")
    summary = joined.groupBy("game").agg(
        F.count(F.lit(1)).alias("expected_videos"),
        F.count("__ok").alias("available_videos"),
        F.count_if(F.col("__ok").isNull()).alias("missing_videos"),
    )
    if allow_partial:
        return summary
    return stop_unless(summary, F.col("missing_videos") == 0, F.concat("game", F.lit(": clips are missing")))
