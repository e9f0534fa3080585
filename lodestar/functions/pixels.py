"""Pointwise image algebra and layer statistics on arrays of pixel values, as Column expressions.

An image is a struct (x, y, z, data) whose data are flat, ``pixel * z + layer``; one layer is a plain array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.arrays import scaled_to_unit, total


def multiply(p: Column, c: float) -> Column:
    return F.transform(p, lambda x: x * F.lit(c))


def add(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: x + y)


def divide(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0.0)), F.lit(0.0)))


def absolute(p: Column) -> Column:
    return F.transform(p, F.abs)


def power(p: Column, e: float) -> Column:
    return F.transform(p, lambda x: F.pow(x, F.lit(e)))


def signed_power(p: Column, e: float) -> Column:
    return F.transform(p, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(e)))


def gamma(p: Column, g: float) -> Column:
    return power(p, 1.0 / g)


def contrast(p: Column, low: float, high: float) -> Column:
    """Stretched so that low and high become 0 and 1, cut off beyond."""
    return F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(low)) / F.lit(high - low))))


def threshold(p: Column, t: float) -> Column:
    return F.transform(p, lambda x: F.when(x >= t, F.lit(1.0)).otherwise(F.lit(0.0)))


def cutoff(p: Column, low: float, high: float) -> Column:
    return F.transform(p, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def shift(p: Column, c: float) -> Column:
    return F.transform(p, lambda x: x + F.lit(c))


def layer(data: Column, z: int, i: int) -> Column:
    return F.filter(data, lambda x, k: k % z == i)


def normalize(p: Column) -> Column:
    return scaled_to_unit(p)


def mean_variance(p: Column) -> Column:
    m = total(p) / F.nullif(F.size(p), F.lit(0))
    return F.struct(m.alias("mean"), (total(F.transform(p, lambda x: x * x)) / F.nullif(F.size(p), F.lit(0)) - m * m).alias("variance"))


def standardize(p: Column) -> Column:
    """Mean 0 and variance 1; all zeros for a constant layer."""
    s = mean_variance(p)
    return F.transform(p, lambda x: F.coalesce((x - s["mean"]) / F.nullif(F.sqrt(F.greatest(s["variance"], F.lit(0.0))), F.lit(0.0)), F.lit(0.0)))


def equalized(p: Column, bins: int = 256) -> Column:
    """Histogram equalisation of values in [0, 1]: each becomes the share of values in its bin and below."""
    at = F.transform(p, lambda x: F.least(F.floor(x * F.lit(bins)), F.lit(bins - 1)))
    return F.transform(at, lambda b: F.size(F.filter(at, lambda c: c <= b)).cast("double") / F.size(p))


def extrema(p: Column) -> Column:
    """(low, high, at_low, at_high), positions from 0, the first of equals."""
    low, high = F.array_min(p), F.array_max(p)
    return F.struct(low.alias("low"), high.alias("high"), (F.array_position(p, low) - 1).alias("at_low"), (F.array_position(p, high) - 1).alias("at_high"))


def is_gray(data: Column, z: int) -> Column:
    """Whether all layers of every pixel are equal."""
    first = F.transform(data, lambda x, k: F.get(data, (k - k % z).cast("int")))
    return F.forall(F.zip_with(data, first, lambda x, y: x == y), lambda ok: ok)
