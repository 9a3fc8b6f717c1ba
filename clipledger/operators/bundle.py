"""Evaluation bundles: which clips to evaluate, and what they cover."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.session import cut_lineage
from clipledger.vocabulary import DEVELOPMENT_GAME, EVENT_LABELS

_CLIP = ["game", "clip"]


def seeded_order(seed: int, *columns: str):
    """Repeatable pseudo-random order of rows by a seeded hash of their key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def pick_games(
    games: DataFrame, seed: int, count: int, requested: DataFrame | None = None
) -> DataFrame:
    """Requested games, or ``count`` games in seeded order without the tuning game."""
    if requested is not None:
        return games.join(requested.select("game"), "game", "left_semi").select("game").distinct()
    pool = games.select("game").distinct().filter(F.col("game") != DEVELOPMENT_GAME)
    return pool.orderBy(seeded_order(seed, "game"), "game").limit(count).select("game")


def clip_strata(clips: DataFrame, events: DataFrame) -> DataFrame:
    """Clips with their distinct labels (possibly none)."""
    strata = events.groupBy(*_CLIP).agg(F.array_sort(F.collect_set("event")).alias("strata"))
    return clips.join(strata, _CLIP, "left").withColumn(
        "strata", F.coalesce("strata", F.array().cast("array<string>"))
    )


def sample_bundle(
    clips: DataFrame, events: DataFrame, seed: int, per_class: int, all_clips: bool = False
) -> DataFrame:
    """Clips for evaluation, filling the rarest label first.

    At most ``per_class`` clips are added per label, so no label can look at
    more than ``10 * per_class`` clips of its own in seeded order. That shortlist
    is cut per label by a limited rank (before the shuffle). Then each label in
    turn adds the first clips it lacks: an anti join with what is chosen already
    and an ordered limit, ten small steps however many clips there are.
    """
    described = clip_strata(clips, events)
    if all_clips:
        return described
    available = events.join(clips.select(*_CLIP), _CLIP, "left_semi").groupBy("event").agg(
        F.count(F.lit(1)).alias("available")
    )
    rarity = {r["event"]: r["available"] for r in available.filter(F.col("event").isin(*EVENT_LABELS)).collect()}
    exploded = described.withColumn("order_hash", seeded_order(seed, *_CLIP)).select(
        *_CLIP, "strata", "order_hash", F.explode("strata").alias("label")
    )
    order = Window.partitionBy("label").orderBy("order_hash", *_CLIP)
    shortlist = cut_lineage(
        exploded.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= len(EVENT_LABELS) * per_class)
        .drop("__rank")
    )
    chosen = shortlist.select(*_CLIP, "strata").limit(0)
    for label in sorted(EVENT_LABELS, key=lambda name: (rarity.get(name, 0), name)):
        missing = per_class - chosen.filter(F.array_contains("strata", label)).count()
        if missing > 0:
            fresh = shortlist.filter(F.col("label") == label).join(chosen.select(*_CLIP), _CLIP, "left_anti")
            added = fresh.orderBy("order_hash", *_CLIP).limit(missing).select(*_CLIP, "strata")
            chosen = cut_lineage(chosen.unionByName(added))
    # Chosen clips carry their strata, so only the clips are read once more.
    return clips.join(chosen.dropDuplicates(_CLIP), _CLIP)


def class_coverage(bundle: DataFrame) -> DataFrame:
    """Clips per label (zeros included), from their strata."""
    counts = bundle.select(F.explode("strata").alias("event")).groupBy("event").agg(
        F.count(F.lit(1)).alias("clips")
    )
    grid = bundle.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in EVENT_LABELS])).alias("event")
    )
    return grid.join(counts, "event", "left").na.fill(0, ["clips"])


def bundle_totals(bundle: DataFrame) -> DataFrame:
    return bundle.agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if(F.size("strata") == 0).alias("unmapped_candidate_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )
