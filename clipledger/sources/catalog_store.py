"""Two ways to keep a catalog: published for searching, and kept up to date by key.

*Published*: bucketed tables. All tables are dealt into the same buckets of ``material_id``,
so semi joins between them need no exchange. Event rows also have a folder per event name,
which a search for an event alone reads; inside the files rows are sorted by person, and
Parquet Bloom filters tell readers which row groups can hold one.

*Kept*: folders of key ranges. Saving materials rewrites the folders of their keys
and leaves all other files as they are; a folder whose rows would stay the same isn't
rewritten, so saving twice changes nothing and a save that was cut off can be repeated.
"""

from dataclasses import replace as dc_replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.operators.catalog import Catalog
from clipledger.operators.guards import stop_unless
from clipledger.session import cut_lineage

KEY = "material_id"
BUCKETS = 16
#: Order of rows inside the files, and the columns with Bloom filters.
_SORTED = {
    "materials": [KEY],
    "material_events": ["participant_id", "confidence"],
    "material_participants": ["participant_id"],
}
_BLOOM = {"materials": [KEY], "material_events": ["participant_id"], "material_participants": ["participant_id"]}
_FOLDERS = {"material_events": ["event_name"]}


# ---- published ------------------------------------------------------------------


def publish_catalog(catalog: Catalog, path: str, name: str, buckets: int = BUCKETS) -> Catalog:
    """Write the tables of ``catalog`` below ``path``, register them as ``name_...`` and return them from there.

    Every event row needs a name, which is its folder.
    """
    out = {}
    for table, rows in catalog.tables().items():
        if table not in _SORTED:
            rows.write.mode("errorifexists").parquet(f"{path}/{table}")
            out[table] = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{table}")
            continue
        folders = _FOLDERS.get(table, [])
        for column in folders:
            rows = stop_unless(rows, F.coalesce(column, F.lit("")) != "", F.lit(f"{column} is missing"))
        # a task per bucket: one file per bucket and folder, not one per task
        dealt = rows.repartition(buckets, KEY)
        writer = dealt.write.format("parquet").mode("errorifexists").option("path", f"{path}/{table}").bucketBy(buckets, KEY).sortBy(*_SORTED[table])
        for column in _BLOOM[table]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        (writer.partitionBy(*folders) if folders else writer).saveAsTable(f"{name}_{table}")
        out[table] = rows.sparkSession.table(f"{name}_{table}").select(*rows.columns)
    return Catalog(**out)


def open_catalog(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS) -> Catalog:
    """The tables of an earlier session's ``publish_catalog``, registered anew from their files."""
    out = {}
    for table in Catalog.__dataclass_fields__:
        stored = spark.read.parquet(f"{path}/{table}")
        if table not in _SORTED:
            out[table] = stored
            continue
        if not spark.catalog.tableExists(f"{name}_{table}"):
            folders = _FOLDERS.get(table, [])
            columns = ", ".join(f"`{f.name}` {'string' if f.name in folders else f.dataType.simpleString()}" for f in stored.schema.fields)
            parted = f"PARTITIONED BY ({', '.join(folders)})" if folders else ""
            spark.sql(
                f"CREATE TABLE {name}_{table} ({columns}) USING parquet {parted} "
                f"CLUSTERED BY ({KEY}) SORTED BY ({', '.join(_SORTED[table])}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'"
            )
            if folders:
                spark.catalog.recoverPartitions(f"{name}_{table}")
        out[table] = spark.table(f"{name}_{table}")
    return Catalog(**out)


# ---- kept by key ------------------------------------------------------------------


def _part(parts: int):
    return F.pmod(F.xxhash64(KEY), F.lit(parts)).cast("int")


def write_keyed(rows: DataFrame, path: str, parts: int = 64) -> None:
    """A folder per range of hashed keys."""
    rows.withColumn("__part", _part(parts)).repartition("__part").write.mode("errorifexists").partitionBy("__part").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("__part")


def replace_keyed(path: str, keys: DataFrame, rows: DataFrame, parts: int = 64) -> int:
    """Take the rows of ``keys`` out of a keyed table and put ``rows`` in; returns how many folders changed.

    ``rows`` must be of these keys, of which there may be none left.
    """
    spark = rows.sparkSession
    keys = cut_lineage(keys.select(KEY).distinct().withColumn("__part", _part(parts)))
    touched = [r[0] for r in keys.select("__part").distinct().collect()]  # at most ``parts`` numbers
    if not touched:
        return 0
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "__part"]
    old = stored.filter(F.col("__part").isin(touched))
    fresh = rows.select(*columns).withColumn("__part", _part(parts))

    def signature(df: DataFrame, name: str) -> DataFrame:
        whole = F.col("__whole")
        return df.groupBy("__part").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(whole, 24)), F.bit_xor(whole)).alias(name))

    def hashed(df: DataFrame) -> DataFrame:
        return df.select(KEY, "__part", F.xxhash64(*columns).alias("__whole"))

    # All other rows stay, so a folder changes if those of the keys do; only hashes travel to tell.
    before = signature(hashed(old).join(keys.select(KEY), KEY, "left_semi"), "before")
    both = before.join(signature(hashed(fresh), "after"), "__part", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    held = old.groupBy("__part").agg(F.count(F.lit(1)).alias("__held"))
    left = sum(F.coalesce(c, F.lit(0)) * sign for c, sign in ((F.col("__held"), 1), (F.col("before.n"), -1), (F.col("after.n"), 1)))
    changed = both.join(held, "__part", "left").select("__part", (left == 0).alias("empty")).collect()
    filled = [r[0] for r in changed if not r.empty]
    if filled:
        # Keys meet the rows of their folder in the one shuffle that brings these to their writer.
        tagged = old.select(*columns, "__part", F.lit(False).alias("__fresh"), F.lit(False).alias("__key"))
        tagged = tagged.unionByName(fresh.select(*columns, "__part", F.lit(True).alias("__fresh"), F.lit(False).alias("__key")))
        marks = keys.filter(F.col(KEY).isNotNull()).select(KEY, "__part", F.lit(False).alias("__fresh"), F.lit(True).alias("__key"))
        tagged = tagged.unionByName(marks, allowMissingColumns=True).filter(F.col("__part").isin(filled)).repartition("__part")
        replaced = F.max("__key").over(Window.partitionBy("__part", KEY))
        new = tagged.withColumn("__replaced", replaced).filter(~F.col("__key") & (F.col("__fresh") | ~F.col("__replaced")))
        new = new.select(*columns, "__part")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(path)
    for part in [r[0] for r in changed if r.empty]:  # an overwrite can't leave a folder empty
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/__part={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(changed)


def write_keyed_catalog(catalog: Catalog, path: str, parts: int = 64) -> None:
    for table in _SORTED:
        write_keyed(getattr(catalog, table), f"{path}/{table}", parts)


def read_keyed_catalog(spark: SparkSession, path: str, catalog: Catalog) -> Catalog:
    """``catalog`` with the tables of materials read from ``path``."""
    return dc_replace(catalog, **{table: read_keyed(spark, f"{path}/{table}") for table in _SORTED})


def save_keyed(path: str, source: Catalog, parts: int = 64) -> int:
    """Replace materials with all that belongs to them; returns how many folders changed.

    What belongs to them goes first, so a save that was cut off is found by saving again.
    """
    keys = source.materials.select(KEY)
    tables = sorted(_SORTED, key=lambda x: x == "materials")
    return sum(replace_keyed(f"{path}/{x}", keys, getattr(source, x), parts) for x in tables)
