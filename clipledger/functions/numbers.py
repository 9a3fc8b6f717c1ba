"""Interval, probability and rounding expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is zero for a zero denominator."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def valid_interval(start: Column, end: Column) -> Column:
    infinite = F.lit(float("inf"))
    ok = (start >= 0) & (end > start) & (end < infinite) & ~F.isnan(start) & ~F.isnan(end)
    return F.coalesce(ok, F.lit(False))


def interval_overlap(
    start: Column,
    end: Column,
    ref_start: Column,
    ref_end: Column,
    over_shorter: bool = False,
    strict: bool = True,
) -> Column:
    """Intersection over union, or over the shorter interval.

    An invalid interval stops the query, or gives NULL when not ``strict``.
    """
    shared = F.greatest(F.lit(0.0), F.least(end, ref_end) - F.greatest(start, ref_start))
    length, ref_length = end - start, ref_end - ref_start
    base = F.least(length, ref_length) if over_shorter else length + ref_length - shared
    ok = valid_interval(start, end) & valid_interval(ref_start, ref_end)
    bad = F.raise_error(F.lit("invalid time interval")).cast("double") if strict else F.lit(None)
    return F.when(ok, ratio(shared, base)).otherwise(bad)


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(logits, lambda v: F.exp(v - top) / total)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(
        F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.transform(logits, lambda v: v - top - F.log(total))


def argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def smooth_one_hot(label: Column, classes: int, smoothing: float) -> Column:
    """Label-smoothed one-hot vector."""
    floor = smoothing / classes
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(i == label, F.lit(1.0 - smoothing + floor)).otherwise(F.lit(floor)),
    )


def bootstrap_cross_entropy(
    logits: Column, label: Column, classes: int, smoothing: float, alpha: float
) -> Column:
    """Cross entropy against a mix of the smoothed label and the prediction itself."""
    target = F.zip_with(
        smooth_one_hot(label, classes, smoothing),
        softmax(logits),
        lambda t, p: F.lit(alpha) * t + F.lit(1.0 - alpha) * p,
    )
    terms = F.zip_with(target, log_softmax(logits), lambda t, lp: -t * lp)
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def spread_positions(length: Column, count: int, form: str = "step") -> Column:
    """At most ``count`` distinct positions spread evenly over ``0..length-1``.

    Ties round to even. ``form`` picks the arithmetic: ``step`` multiplies a
    precomputed step, ``ratio`` divides last. Short inputs keep every position.
    """
    everything = F.sequence(F.lit(0).cast("bigint"), length.cast("bigint") - 1)
    if count == 1:
        few = F.array(F.lit(0).cast("bigint"))
        return F.when(length <= 0, F.array().cast("array<bigint>")).otherwise(few)
    last = (length - 1).cast("double")
    gaps = F.lit(float(count - 1))

    def place(i: Column) -> Column:
        if form == "ratio":
            return F.rint(i.cast("double") * last / gaps).cast("bigint")
        return F.when(i == count - 1, last.cast("bigint")).otherwise(
            F.rint(i.cast("double") * (last / gaps)).cast("bigint")
        )

    few = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), place))
    return (
        F.when(length <= 0, F.array().cast("array<bigint>"))
        .when(length <= count, everything)
        .otherwise(few)
    )
