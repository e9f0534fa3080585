"""The library of distance functions, as builders of Column expressions.

``a`` is the column of the stored object, ``b`` that of the query object. Each builder documents its
formula; divisions and logarithms are guarded, so that no expression raises under ANSI mode. Where
published descriptions of a measure and common implementations differ, the described intent is the default and
``compat=True`` gives the other reading.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.arrays import norm, total, zip_sum


def zero(a: Column, b: Column) -> Column:
    return F.lit(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Squared L2."""
    return zip_sum(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return zip_sum(a, b, lambda x, y: F.abs(x - y))


def weighted_euclidean(a: Column, b: Column, weight: float = 0.5) -> Column:
    """2(1-w) times the squared L2 of all but the last two dimensions plus 2w times that of these two."""
    head = euclidean(F.slice(a, F.lit(1), F.size(a) - 2), F.slice(b, F.lit(1), F.size(b) - 2))
    tail = euclidean(F.slice(a, -2, 2), F.slice(b, -2, 2))
    return F.lit(2 * (1 - weight)) * head + F.lit(2 * weight) * tail


def weighted_l1(a: Column, b: Column, weights: list[float]) -> Column:
    return zip_sum(F.array(*map(F.lit, weights)), F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda w, d: w * d)


def chisquare(a: Column, b: Column) -> Column:
    return zip_sum(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / F.nullif(x + y, F.lit(0.0))).otherwise(F.lit(0.0)))


def histogram_intersection(a: Column, b: Column) -> Column:
    return F.lit(1.0) - zip_sum(a, b, lambda x, y: F.least(x, y))


def _log_term(x: Column, y: Column) -> Column:
    """x ln(2x / (x + y)), 0 at x = 0."""
    return F.when(x > 0, x * F.ln(F.lit(2.0) * x / F.nullif(x + y, F.lit(0.0)))).otherwise(F.lit(0.0))


def jsd(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence."""
    return zip_sum(a, b, lambda x, y: _log_term(x, y) + _log_term(y, x))


def kld(a: Column, b: Column) -> Column:
    """Kullback-Leibler divergence over bins that both have."""
    return zip_sum(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / F.nullif(y, F.lit(0.0)))).otherwise(F.lit(0.0)))


def relative_deviation(a: Column, b: Column) -> Column:
    return F.coalesce(F.sqrt(euclidean(a, b)) / F.nullif(F.lit(0.5) * (norm(a) + norm(b)), F.lit(0.0)), F.lit(0.0))


def relative_bin_deviation(a: Column, b: Column) -> Column:
    each = zip_sum(a, b, lambda x, y: F.coalesce(F.abs(x - y) / F.nullif(F.lit(0.5) * (x * x + y * y), F.lit(0.0)), F.lit(0.0)))
    return F.coalesce(each / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def fidelity(a: Column, b: Column) -> Column:
    """Bhattacharyya coefficient, the similarity under the four measures below."""
    return zip_sum(a, b, lambda x, y: F.sqrt(x) * F.sqrt(y))


def one_minus_fidelity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - fidelity(a, b)


def sqrt_one_minus_fidelity(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(1.0) - fidelity(a, b), F.lit(0.0)))


def log_two_minus_fidelity(a: Column, b: Column) -> Column:
    return F.ln(F.greatest(F.lit(2.0) - fidelity(a, b), F.lit(1e-300)))


def arccos_fidelity(a: Column, b: Column) -> Column:
    return F.lit(2 / math.pi) * F.acos(F.least(fidelity(a, b), F.lit(1.0)))


def sin_fidelity(a: Column, b: Column, compat: bool = False) -> Column:
    """sqrt(1 - F^2); ``compat`` gives sqrt(1 - F)."""
    if compat:
        return sqrt_one_minus_fidelity(a, b)
    f = fidelity(a, b)
    return F.sqrt(F.greatest(F.lit(1.0) - f * f, F.lit(0.0)))


def cross_correlation_1d(a: Column, b: Column, shift: int = 4) -> Column:
    """1 - the largest normalised correlation of two equally long signals over shifts of up to ``shift``."""
    denominator = F.nullif(norm(a) * norm(b), F.lit(0.0))
    scores = []
    for s in range(-shift, shift + 1):
        x = F.slice(a, F.lit(1 + max(s, 0)), F.greatest(F.size(a) - abs(s), F.lit(0)))
        y = F.slice(b, F.lit(1 + max(-s, 0)), F.greatest(F.size(b) - abs(s), F.lit(0)))
        scores.append(zip_sum(x, y, lambda p, q: p * q))
    return F.lit(1.0) - F.coalesce(F.greatest(*scores) / denominator, F.lit(0.0))


def binary(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))


def meta(a: Column, b: Column) -> Column:
    """How many of the query's keys are missing in the stored map or differ."""
    return F.size(F.filter(F.map_entries(b), lambda e: ~F.element_at(a, e["key"]).eqNullSafe(e["value"]))).cast("double")


# Sparse histograms: maps from bin to relative frequency.


def _sparse(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    joined = F.map_zip_with(a, b, lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    return total(F.map_values(joined))


def sparse_jsd(a: Column, b: Column) -> Column:
    return _sparse(a, b, lambda x, y: _log_term(x, y) + _log_term(y, x))


def sparse_fidelity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - _sparse(a, b, lambda x, y: F.sqrt(x) * F.sqrt(y))


# Nested features.


def histogram_pair(a: Column, b: Column, weight: float = 0.5, ground: Callable[[Column, Column], Column] = jsd) -> Column:
    """Least weighted distance of foreground and background over all pairs of parts; both sides are arrays of (fg, bg)."""
    return F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.lit(weight) * ground(p["fg"], q["fg"]) + F.lit(1 - weight) * ground(p["bg"], q["bg"])))))


def faces(a: Column, b: Column, use: str = "one") -> Column:
    """Squared L2 between face vectors: the least over all pairs, or the sum over the query's faces of their least.

    Without stored faces the query's squared norms stand in; without query faces the distance is 0.
    """
    pick = (lambda x: F.array_min(x)) if use == "one" else total
    against = F.transform(b, lambda q: F.array_min(F.transform(a, lambda p: euclidean(p, q))))
    norms = F.transform(b, lambda q: total(F.transform(q, lambda e: e * e)))
    return F.when(F.size(b) == 0, F.lit(0.0)).when(F.size(a) == 0, pick(norms)).otherwise(pick(against))


Builder = Callable[..., Column]

#: Names and aliases by which distances are chosen (fixed values).
REGISTRY: dict[str, Builder] = {
    "base": zero, "basedist": zero,
    "euclidean": euclidean,
    "l1": l1, "cityblock": l1,
    "weightedeuclidean": weighted_euclidean,
    "weightedl1": weighted_l1,
    "chisquare": chisquare,
    "histogramintersection": histogram_intersection, "his": histogram_intersection,
    "jsd": jsd, "jd": jsd,
    "kld": kld,
    "reldev": relative_deviation, "relativedeviation": relative_deviation,
    "relbindev": relative_bin_deviation, "relativebindeviation": relative_bin_deviation,
    "fidelity": one_minus_fidelity, "omf": one_minus_fidelity, "oneminusfidelity": one_minus_fidelity,
    "sqrtoneminusfidelity": sqrt_one_minus_fidelity,
    "logtwominusfidelity": log_two_minus_fidelity,
    "arccosfidelity": arccos_fidelity,
    "sinfidelity": sin_fidelity, "oneminusfidelitysquare": sin_fidelity,
    "crosscorrelation": cross_correlation_1d,
    "binary": binary, "binaryfeature": binary,
    "metafeature": meta,
    "histpair": histogram_pair,
    "facefeature": faces, "facefeat": faces,
}

#: Names of the distances of maps from bin to share, which the names of dense ones stand for on such columns.
SPARSE: dict[str, Builder] = {"sparsejsd": sparse_jsd, "sparsefidelity": sparse_fidelity}

#: The distance of a feature type where none is named.
DEFAULTS = {"vector": "euclidean", "image": "idm", "histogram": "jsd", "sparse": "sparsejsd", "meta": "metafeature", "binary": "binary", "faces": "facefeature", "pair": "histpair"}

#: Parameters by the names that distance specifications use.
PARAMETERS = {"WEIGHT": ("weight", float), "CWEIGHT": ("weight", float), "D": ("shift", int), "USE": ("use", str), "COMPAT": ("compat", lambda x: x.lower() in ("1", "true", "yes"))}


def distance(spec: str) -> Builder:
    """The builder for ``name:KEY=value:KEY=value``; unknown names and keys raise."""
    name, *options = spec.split(":")
    known = REGISTRY | SPARSE
    if name.lower() not in known:
        raise ValueError(f"unknown distance {name!r}")
    given = {}
    for option in options:
        key, _, value = option.partition("=")
        if key.upper() not in PARAMETERS:
            raise ValueError(f"unknown parameter {key!r} of distance {name!r}")
        target, convert = PARAMETERS[key.upper()]
        given[target] = convert(value)
    builder = known[name.lower()]
    return (lambda a, b: builder(a, b, **given)) if given else builder
