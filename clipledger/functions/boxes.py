"""Bounding-box predicates and conversions on plain columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_box(width: Column, height: Column, min_size: float = 0.0) -> Column:
    """Whether a box is larger than ``min_size`` both ways; NULL boxes are not.

    Pass 0 for model input, 1 for sampling and masking.
    """
    ok = (width > F.lit(min_size)) & (height > F.lit(min_size))
    return F.coalesce(ok & ~F.isnan(width) & ~F.isnan(height), F.lit(False))


def is_finite_box(x: Column, y: Column, width: Column, height: Column, min_size: float) -> Column:
    """Like ``is_box`` and every coordinate is a finite number."""
    finite = F.lit(True)
    for value in (x, y, width, height):
        finite = finite & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.coalesce(finite, F.lit(False)) & is_box(width, height, min_size)


def box_array(value: Column) -> Column:
    """Struct x, y, w, h of an array; NULL unless it has exactly four numbers."""
    parts = [F.get(value, i).cast("double").alias(n) for i, n in enumerate("xywh")]
    complete = (F.size(value) == 4) & F.forall(value, lambda item: item.isNotNull())
    return F.when(complete, F.struct(*parts))


def castable_box(value: Column) -> Column:
    """Struct x, y, w, h from an array of texts; NULL when one is no number or empty."""
    parts = [F.get(value, i).try_cast("double") for i in range(4)]
    ok = (F.size(value) == 4) & (parts[2] > 0) & (parts[3] > 0)
    ok = ok & parts[0].isNotNull() & parts[1].isNotNull()
    return F.when(ok, F.struct(*[p.alias(n) for p, n in zip(parts, "xywh")]))


def scaled(
    x: Column, y: Column, w: Column, h: Column, scale_x: float, scale_y: float, corners: bool
) -> Column:
    """Scale a box; ``corners`` gives x1, y1, x2, y2 instead of x, y, w, h."""
    x, w = x * F.lit(scale_x), w * F.lit(scale_x)
    y, h = y * F.lit(scale_y), h * F.lit(scale_y)
    if corners:
        w, h = x + w, y + h
    return F.struct(x.alias("b0"), y.alias("b1"), w.alias("b2"), h.alias("b3"))
