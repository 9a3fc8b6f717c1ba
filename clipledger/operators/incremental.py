"""What is left to do, and how a job ended."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.operators.guards import stop_unless


def config_hash(df: DataFrame, result_columns: Sequence[str]) -> DataFrame:
    """Add a hash of the settings that change results.

    Leave out settings that only place the work, such as device numbers.
    """
    fields = F.to_json(F.struct(*sorted(result_columns)))
    return df.withColumn("config_hash", F.sha2(fields, 256))


def config_conflicts(plan: DataFrame, status: DataFrame) -> DataFrame:
    """Videos whose stored windows were made with another configuration."""
    wanted = plan.groupBy("video_id").agg(F.min("config_hash").alias("wanted"))
    stored = status.groupBy("video_id").agg(
        F.min("config_hash").alias("lo"), F.max("config_hash").alias("hi")
    )
    return wanted.join(stored, "video_id").filter(
        "lo <> wanted OR hi <> wanted"
    ).select("video_id")


def pending_windows(plan: DataFrame, status: DataFrame, strict: bool = False) -> DataFrame:
    """Windows to run: not succeeded yet under the same configuration.

    With ``strict`` a changed configuration stops the query.
    """
    done = status.filter("status = 'succeeded'").select("video_id", "window_id", "config_hash")
    pending = plan.join(done, ["video_id", "window_id", "config_hash"], "left_anti")
    if not strict:
        return pending
    changed = config_conflicts(plan, status).withColumn("__changed", F.lit(True))
    joined = pending.join(changed, "video_id", "left")
    same = F.col("__changed").isNull()
    return stop_unless(joined, same, F.concat(F.lit("configuration changed for "), "video_id")).drop("__changed")


def job_summary(windows: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Final state of each video from its windows and failed identities.

    ``windows`` has ``video_id, status`` and optionally ``identity_failed``.
    """
    identity = (
        F.coalesce("identity_failed", F.lit(False)) if "identity_failed" in windows.columns else F.lit(False)
    )
    grouped = windows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("status") == "failed").alias("failed_windows"),
        F.count_if(identity).alias("failed_identities"),
    )
    failed = F.lit(False) if allow_partial else F.col("failed_windows") > 0
    warned = (F.col("failed_windows") + F.col("failed_identities")) > 0
    return grouped.withColumn(
        "status",
        F.when(failed, "failed").when(warned, "completed_with_warnings").otherwise("completed"),
    )


def scorable_clips(report: DataFrame) -> DataFrame:
    """Whether each prepared clip can be scored; one without players is skipped."""
    return report.select(
        "clip_id",
        "player_count",
        F.when(F.col("player_count") > 0, "completed").otherwise("completed_with_warning").alias("status"),
        F.when(F.col("player_count") > 0, "run").otherwise("skipped").alias("scoring"),
    )
