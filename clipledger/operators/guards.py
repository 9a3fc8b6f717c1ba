"""Checks that stop a query, whatever its caller selects."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stop_unless(df: DataFrame, good: Column, message: Column) -> DataFrame:
    """``df``, whose query stops at a row for which ``good`` doesn't hold.

    A filter on the row stays when columns are pruned or rows are only counted.
    """
    return df.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))
