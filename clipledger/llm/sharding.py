"""Shards of even size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. A group's pull towards each shard is the
number of its members there, so no pair of documents is ever written down.

1. Linked documents start in the shards 0 .. n-1 in turn, which is balanced.
2. In each round every document wants the shard where most of its group is. Spark
   counts who wants to go from where to where (at most n * n numbers) and turns
   them into quotas: two shards may always swap, and beyond that a shard takes what
   its share of rows leaves free. The first so many of every (from, to) move.
3. Documents without links fill the shards up to their exact shares.

The law is ``rows``: shard sizes differ by one row at most, whatever the groups. A
group larger than a share stays split, since no shard may hold it. Everything is
counts, joins and windows over (key, block); the text is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.base import blocks_for, number_rows, save

SHARDS = 24


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, link): UTF-8 bytes plus 8, checksum, and a key of the text."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.substring(F.sha2(raw, 256), 1, 32).alias("link"),
    )


def _shares(rows: int, shards: int):
    """The exact number of rows of a shard."""
    return F.lit(rows // shards) + F.when(F.col("shard") < rows % shards, 1).otherwise(0)


def propagate(linked: DataFrame, shards: int, rows: int) -> DataFrame:
    """Move rows of (row, link, shard) towards their group's shard until no quota lets one move.

    Rows in their group's largest shard stay, so each round brings more rows there and the rounds end.
    """
    blocks = blocks_for(rows)
    spark = linked.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = every.select("shard", _shares(rows, shards).alias("share"))
    while True:
        held = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("members"))
        pull = F.struct("members", F.xxhash64("link", "shard").alias("_tie"), "shard")
        wanted = held.groupBy("link").agg(F.max(pull).alias("_best")).select("link", F.col("_best.shard").alias("target"))
        wishes = save(linked.join(wanted, "link"))
        moves = wishes.where("shard <> target")
        demand = moves.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("wish"))
        mirror = demand.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("wish").alias("back"))
        free = room.join(linked.groupBy("shard").agg(F.count(F.lit(1)).alias("here")), "shard", "left").select(
            F.col("shard").alias("target"), F.greatest(F.lit(0), F.col("share") - F.coalesce("here", F.lit(0))).alias("free")
        )
        swap = F.least("wish", F.coalesce("back", F.lit(0)))
        earlier = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        quota = (
            demand.join(mirror, ["shard", "target"], "left")
            .join(free, "target")
            .select("shard", "target", "free", swap.alias("swap"), (F.col("wish") - swap).alias("more"))
            .withColumn("_used", F.coalesce(F.sum("more").over(earlier), F.lit(0)))
            .select("shard", "target", (F.col("swap") + F.greatest(F.lit(0), F.least("more", F.col("free") - F.col("_used")))).alias("quota"))
        )
        quota = save(quota.where("quota > 0"))  # at most a row per pair of shards
        if quota.isEmpty():
            return linked
        turns = number_rows(moves, "_turn", ["shard", "target"], ["row"], ["link", "row"], blocks)
        moved = turns.join(quota, ["shard", "target"]).where("_turn < quota").select("row", "target")
        new = F.coalesce(F.col("_to.target"), F.col("_at.shard")).alias("shard")
        linked = save(linked.alias("_at").join(moved.alias("_to"), "row", "left").select("row", "_at.link", new))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document with its ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: the law is ``rows``).

    A null text has size 8 and counts as empty; repeated rows and null keys are rows
    like any other; without rows nothing is returned.
    """
    sized = save(document_sizes(docs))
    rows = sized.count()
    blocks = blocks_for(rows)
    # a number per row, so that repeated rows are told apart from here on
    numbered = save(number_rows(sized, "row", [], ["doc_id", "link"], ["doc_id", "link"], blocks))
    shared = numbered.groupBy("link").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("link")
    linked = numbered.join(shared, "link", "left_semi").select("row", "link")
    placed = save(number_rows(save(linked), "_place", [], ["row"], ["row"], blocks).select("row", "link", (F.col("_place") % shards).cast("int").alias("shard")))
    placed = propagate(placed, shards, rows)
    # the rows without links fill what is left: shard s takes the places from its first to its last
    taken = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("here"))
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    left = every.join(taken, "shard", "left").select("shard", (_shares(rows, shards) - F.coalesce("here", F.lit(0))).alias("left"))
    upto = Window.orderBy("shard")  # one row per shard
    ranges = left.select("shard", "left", F.sum("left").over(upto).alias("upto"))
    chosen = F.lit(None).cast("int")
    for x in ranges.orderBy(F.desc("shard")).collect():  # one row per shard
        chosen = F.when(F.col("_place") < x["upto"], x["shard"]).otherwise(chosen)
    single = save(numbered.join(shared, "link", "left_anti").select("row"))
    alone = number_rows(single, "_place", [], ["row"], ["row"], blocks)
    filled = alone.select("row", chosen.alias("shard"))
    both = save(numbered.join(placed.select("row", "shard").unionByName(filled), "row"))
    slots = number_rows(both, "slot", ["shard"], ["row"], ["row"], blocks)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(sharded: DataFrame, link: str) -> DataFrame:
    """Documents outside their group's largest shard: what the moves make small."""
    per = sharded.groupBy(link, "shard").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(link).agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.sum("cut").alias("cut"))
