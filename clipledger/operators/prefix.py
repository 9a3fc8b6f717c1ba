"""Running values over long ordered groups, computed bucket by bucket.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task,
which breaks down when one video or track holds a large part of the data. Here
every key is cut into ordered buckets: a window runs inside ``(key, bucket)``,
one partial aggregate per bucket is carried forward over the few bucket rows,
and both are combined. The large side is shuffled once, on ``(key, bucket)``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"

_AGGREGATES = {"max": F.max, "min": F.min, "sum": F.sum}


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    values: dict[str, tuple[str, Column, bool]],
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates of ``values`` in ``order`` within ``keys``.

    ``values`` maps a new column to ``(kind, expression, inclusive)`` with kind
    ``max``, ``min`` or ``sum``; exclusive values cover the earlier rows only
    (NULL, or 0 for sums, on the first row). ``totals`` adds whole-key
    aggregates from the same bucket summary. ``bucket`` must not decrease along
    ``order``; keys and bucket must not be NULL.
    """
    totals = totals or {}
    rows = df.withColumn(_BUCKET, bucket)
    group = [*keys, _BUCKET]

    aggregates = [
        _AGGREGATES[kind](expr).alias(f"__s_{name}") for name, (kind, expr, _) in values.items()
    ] + [_AGGREGATES[kind](expr).alias(f"__t_{name}") for name, (kind, expr) in totals.items()]
    # Partial aggregation leaves one row per bucket; only these rows meet in a
    # per-key window.
    summary = rows.groupBy(*group).agg(*aggregates)
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    summary = summary.select(
        *group,
        *[
            _AGGREGATES[kind](F.col(f"__s_{name}")).over(earlier).alias(f"__c_{name}")
            for name, (kind, _, _) in values.items()
        ],
        *[
            _AGGREGATES[kind](F.col(f"__t_{name}")).over(whole).alias(name)
            for name, (kind, _) in totals.items()
        ],
    )

    inside = Window.partitionBy(*group).orderBy(*order)
    local = rows
    for name, (kind, expr, inclusive) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = local.withColumn(f"__l_{name}", _AGGREGATES[kind](expr).over(frame))
    joined = local.join(summary, group)
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name)
            for name, (kind, _, _) in values.items()
        ],
        *totals,
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its key, and optionally the row count."""
    one = F.lit(1).cast("bigint")
    return running(
        df,
        keys,
        order,
        bucket,
        {name: ("sum", one, False)},
        {total: ("sum", one)} if total else None,
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Sequence[str],
    name: str = "previous",
) -> DataFrame:
    """Add the previous row's ``columns`` as a struct (``lag`` for long groups).

    The previous row is the greatest earlier ``order`` tuple, so the running
    maximum of ``(order, columns)`` is exactly it.
    """
    payload = F.struct(*order, F.struct(*columns).alias("row"))
    out = running(
        df, keys, [F.col(c) for c in order], bucket, {name: ("max", payload, False)}
    )
    return out.withColumn(name, F.col(name)["row"])


#: Buckets of a key's values, each of about as many different ones.
_SHARES = 64


def value_buckets(counted: DataFrame, keys: Sequence[str], value: str, shares: int = _SHARES) -> DataFrame:
    """Add ``__share``: where a value lies among approximate quantiles of its key's values.

    Quantiles follow the values, so buckets are even however narrow or skewed their range
    is. They only deal out the rows: positions are counted exactly, whatever the cuts.
    """
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx(value, [k / shares for k in range(1, shares)], 100 * shares).alias("__cuts")
    )
    dealt = counted.join(cuts, [*keys])
    return dealt.withColumn("__share", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column | None, name: str
) -> DataFrame:
    """Exact median per key without holding a key's values in memory.

    Equal values are counted first, the counts are accumulated over ordered
    buckets and the one or two middle values are picked. ``bucket`` must not
    decrease with the value; without one, buckets are cut at quantiles.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    if bucket is None:
        counted, bucket = value_buckets(counted, keys, value), F.col("__share")
    placed = running(
        counted,
        keys,
        [F.col(value)],
        bucket,
        {"__upto": ("sum", F.col("__n"), True)},
        {"__all": ("sum", F.col("__n"))},
    )
    low = F.expr("(__all - 1) div 2")
    high = F.expr("__all div 2")
    start = F.col("__upto") - F.col("__n")
    picked = placed.select(
        *keys,
        F.when((low >= start) & (low < F.col("__upto")), F.col(value)).alias("__lo"),
        F.when((high >= start) & (high < F.col("__upto")), F.col(value)).alias("__hi"),
    )
    return picked.groupBy(*keys).agg(
        ((F.max("__lo") + F.max("__hi")) / 2).alias(name)
    )


#: Intervals from 2^60 widths on, and those without an end, share one level of a single cell.
_TOP = 61
#: Parts of a cell that is longer than the width, so that its points don't meet in one task.
_PARTS = 16


def _level_cells(at: Column, level: Column, width: float) -> Column:
    """The cell of a time on a level; cells of level k are 2^k widths long."""
    return F.when(level == _TOP, F.lit(0).cast("bigint")).otherwise(F.floor(at / (F.pow(F.lit(2.0), level) * width)))


def interval_cells(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Add ``__level``, ``__cell`` and ``__part``: where an interval is found, in two cells of its level at most.

    An interval's level has the shortest cells that are as long as it. Cells above the
    lowest level have parts; the interval lies in each of them.
    """
    known = intervals.filter(F.col(end) >= F.col(start))
    widths = (F.col(end) - F.col(start)) / width
    level = F.when(widths <= 1, F.lit(0)).when(widths < 2.0 ** (_TOP - 1), F.ceil(F.log2(widths))).otherwise(F.lit(_TOP))
    known = known.withColumn("__level", level.cast("int"))
    first, last = (_level_cells(F.col(c), F.col("__level"), width) for c in (start, end))
    parts = F.when(F.col("__level") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    return known.withColumn("__cell", F.explode(F.sequence(first, last))).withColumn("__part", F.explode(parts))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: float,
    closed_end: bool,
) -> DataFrame:
    """Inner join of points with the intervals containing them.

    Time is cut into cells on levels of 1, 2, 4, ... ``width``, and an interval is put
    into the cells of the level of its own length, however long it is. A point looks
    into one cell per level that occurs. Both meet on ``(keys, level, cell, part)``,
    so no nested loop is planned, and a pair meets once. Pick ``width`` near
    the usual interval length.
    """
    right = interval_cells(intervals, start, end, width)
    occurring = right.select(F.sort_array(F.collect_set("__level"))).scalar()
    left = points.withColumn("__level", F.explode(occurring))
    left = left.withColumn("__cell", _level_cells(F.col(at), F.col("__level"), width))
    part = F.when(F.col("__level") == 0, F.lit(0)).otherwise(F.pmod(F.floor(F.col(at) / width), F.lit(_PARTS)))
    left = left.withColumn("__part", part.cast("int"))
    inside = F.col(at) <= F.col(end) if closed_end else F.col(at) < F.col(end)
    # Sizes are estimated before rows are exploded, so neither side may be taken for small.
    joined = left.hint("merge").join(right, [*keys, "__level", "__cell", "__part"])
    return joined.filter((F.col(at) >= F.col(start)) & inside).drop("__level", "__cell", "__part")
