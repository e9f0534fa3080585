"""Array algebra as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def zip_sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(zipped(a, b, f))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda e: e * e)))


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def argmin(x: Column) -> Column:
    """0-based position of the least element."""
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def drop_range(x: Column, start: int, end: int) -> Column:
    """Without the 0-based positions start..end."""
    return F.concat(F.slice(x, 1, start), F.slice(x, F.lit(end + 2), F.greatest(F.size(x) - F.lit(end + 1), F.lit(0))))


def zero_dimension(x: Column, d: int) -> Column:
    return F.transform(x, lambda e, i: F.when(i == d, F.lit(0.0)).otherwise(e))


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def scaled_to_unit(x: Column) -> Column:
    """Min-max scaled to [0, 1]; all zeros when the values are equal."""
    low, high = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda e: F.when(high > low, (e - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0)))
