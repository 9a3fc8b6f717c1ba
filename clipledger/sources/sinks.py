"""Writing results: line-delimited manifests, reports and product tables."""

from pyspark.sql import DataFrame

from clipledger.operators.catalog import Catalog


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object per line, NULL fields kept, optionally one folder per ``by``.

    Rows of a folder are dealt to few tasks first, or every task would open a file in every folder.
    """
    out = df.hint("rebalance", by) if by else df
    writer = out.write.option("ignoreNullFields", False).mode("errorifexists")
    (writer.partitionBy(by) if by else writer).json(path)


def write_table(df: DataFrame, path: str, by: str | None = None, sort: list[str] | None = None) -> None:
    """Parquet, clustered by ``by`` and sorted inside the files for pruning.

    Rebalancing keeps files evenly sized even when one value dominates.
    """
    out = df
    if by:
        out = out.hint("rebalance", by)
    if sort:
        out = out.sortWithinPartitions(*([by] if by else []), *sort)
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_catalog(catalog: Catalog, path: str) -> None:
    """One folder per table below a new version folder; never overwrites."""
    order = {
        "participants": ["participant_id"],
        "materials": ["source_video_id", "start_seconds"],
        "material_events": ["event_name", "confidence"],
        "material_participants": ["participant_id"],
    }
    for name, table in catalog.tables().items():
        write_table(table, f"{path}/{name}", sort=order[name])


def read_catalog(spark, path: str) -> Catalog:
    names = ["participants", "materials", "material_events", "material_participants"]
    return Catalog(**{n: spark.read.parquet(f"{path}/{n}") for n in names})
