"""Scalar functions: option strings, histogram positions, fuzzy membership and colour."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def _escaped(key: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in key)


def double_after(text: Column, key: str, default: float) -> Column:
    """The number after ``key``, sign and exponent included."""
    found = F.regexp_extract(text, _escaped(key) + NUMBER, 1)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(default))


def int_after(text: Column, key: str, default: int) -> Column:
    found = F.regexp_extract(text, _escaped(key) + r"([-+]?[0-9]+)", 1)
    return F.coalesce(F.when(found != "", found.try_cast("int")), F.lit(default))


def string_after(text: Column, key: str, default: str, delimiter: str = ":") -> Column:
    found = F.regexp_extract(text, _escaped(key) + f"([^{_escaped(delimiter)}]*)", 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def suffix(name: Column) -> Column:
    """The feature type that a file name tells: its last dot-separated part, a trailing ``.gz`` aside."""
    return F.element_at(F.split(F.regexp_replace(name, r"\.gz$", ""), r"\."), -1)


def tokens(text: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def meta_map(text: Column) -> Column:
    """``k:v,k:v`` as a map; the last of equal keys counts."""
    parts = F.filter(F.split(text, ","), lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substring_index(p, ":", -1)).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def point_to_position(x: Column, low: float, high: float, steps: int) -> Column:
    """The 0-based bin of a value among ``steps`` equal ones over [low, high], clamped."""
    at = F.floor((x - F.lit(low)) / F.lit((high - low) / steps))
    return F.least(F.greatest(at, F.lit(0)), F.lit(steps - 1)).cast("int")


def positions_to_bin(positions: list[Column], steps: list[int]) -> Column:
    """The flat bin of positions, the first dimension fastest."""
    out, stride = F.lit(0), 1
    for p, n in zip(positions, steps, strict=True):
        out, stride = out + p * F.lit(stride), stride * n
    return out.cast("int")


def position_code(positions: list[Column]) -> Column:
    """The string key of a sparse histogram's bin: one character from '0' on for each dimension."""
    return F.concat(*[F.char(F.lit(48) + p) for p in positions])


def fuzzy_three(x: Column, c: float = 0.5, w: float = 0.25) -> list[Column]:
    """Triangular memberships in low, middle and high around c - w, c and c + w; they add up to 1."""
    low = F.when(x <= c - w, F.lit(1.0)).when(x < c, (F.lit(c) - x) / F.lit(w)).otherwise(F.lit(0.0))
    high = F.when(x >= c + w, F.lit(1.0)).when(x > c, (x - F.lit(c)) / F.lit(w)).otherwise(F.lit(0.0))
    return [low, F.lit(1.0) - low - high, high]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue in radians, saturation and value, from channels in [0, 1]; grey has hue and saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = F.nullif(top - low, F.lit(0.0))
    sixth = F.when(top == r, F.pmod((g - b) / spread, F.lit(6.0))).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    return [F.coalesce(sixth * F.lit(math.pi / 3), F.lit(0.0)), F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)), top]


def hsv_complex(h: Column, s: Column, v: Column) -> list[Column]:
    return [s * F.cos(h), s * F.sin(h), v]


def gray(r: Column, g: Column, b: Column, mode: str = "luminance") -> Column:
    if mode == "max":
        return F.greatest(r, g, b)
    if mode == "mean":
        return (r + g + b) / 3
    return r * 0.3 + g * 0.59 + b * 0.11


def relational(x: Column, y: Column, c: float) -> Column:
    """Ramp from 1 to 0 over differences from -c to c."""
    return F.when(x - y <= -c, F.lit(1.0)).when(x - y >= c, F.lit(0.0)).otherwise((F.lit(c) - (x - y)) / F.lit(2 * c))


def inside(box: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in an annotated box (xmin, ymin, xmax, ymax), borders included."""
    return (x >= box["xmin"]) & (x <= box["xmax"]) & (y >= box["ymin"]) & (y <= box["ymax"])
