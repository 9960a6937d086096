"""NULL-safe numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it never enters a plan."""
    return F.when(~F.isnan(value), value)


def clip01(value: Column) -> Column:
    """Clamp to [0, 1]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def rounded(value: Column, digits: int | None) -> Column:
    """Half-even rounding, or the raw value when ``digits`` is None."""
    return value if digits is None else F.bround(value, digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL on a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def planar_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
