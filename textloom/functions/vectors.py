"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(1 - dot(a, b) / size)


def min_max(x: Column, over: WindowSpec | None = None, constant: float = 0.0, single: float = 1.0) -> Column:
    """x scaled to [0, 1] over a window; NaN counts as the least value."""
    w = over or Window.partitionBy(F.lit(0))
    clean = F.when(F.isnan(x), None).otherwise(x)
    low, high, n = F.min(clean).over(w), F.max(clean).over(w), F.count(F.lit(1)).over(w)
    return F.when(n == 1, single).when(high - low < 1e-12, constant).otherwise((F.coalesce(clean, low) - low) / (high - low))


def freshness(at: Column, now: Column, plateau: int = 7, floor: int = 180) -> Column:
    """1 up to `plateau` days of age, 0 from `floor` days on or without a date, linear between."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0
    return F.when(at.isNull(), 0.0).when(age <= plateau, 1.0).when(age >= floor, 0.0).otherwise((floor - age) / (floor - plateau))
