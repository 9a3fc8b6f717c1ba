"""Incremental twins: process what arrived since the last run."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    source_format: str = "parquet",
) -> None:
    """Run ``transform`` on files not seen by an earlier run and append the result.

    The checkpoint records finished files, so a second run only handles new
    ones, and a run after a crash continues where it stopped. ``transform`` may
    be any row-wise operator (``plan_windows``, ``collect_candidates``,
    ``assign_windows`` against a static video table, ...).
    """
    stream = spark.readStream.schema(schema).format(source_format).load(source)
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
