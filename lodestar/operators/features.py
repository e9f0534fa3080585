"""Feature extraction: rows of pixel arrays to feature columns.

Counts and colour are Column expressions and aggregates; neighbourhood features run over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import imaging
from lodestar.functions.scalar import fuzzy_three, point_to_position, positions_to_bin
from lodestar.operators.steps import few


def aspect_ratio(image: Column) -> Column:
    return F.array(image["x"].cast("double"), image["y"].cast("double"))


def pixel_rows(images: DataFrame, key: str, image: str, layers: int) -> DataFrame:
    """(key, p, c0, c1, ...): one row for each pixel."""
    pixels = F.transform(F.sequence(F.lit(0), (F.size(F.col(f"{image}.data")) / F.lit(layers)).cast("int") - 1), lambda p: F.struct(*[F.get(F.col(f"{image}.data"), (p * layers + i).cast("int")).alias(f"c{i}") for i in range(layers)]))
    return images.select(key, F.posexplode(pixels).alias("p", "e")).select(key, "p", "e.*")


def color_histogram(images: DataFrame, key: str, image: str, layers: int, steps: int) -> DataFrame:
    """(key, bin, n): joint histogram of all layers, the first fastest."""
    rows = pixel_rows(images, key, image, layers)
    positions = [point_to_position(F.col(f"c{i}"), 0.0, 1.0, steps) for i in range(layers)]
    return rows.groupBy(key, positions_to_bin(positions, [steps] * layers).alias("bin")).agg(F.count("*").alias("n"))


def fuzzy_histogram(images: DataFrame, key: str, image: str, c: float = 0.5, w: float = 0.25) -> DataFrame:
    """(key, low, middle, high): summed fuzzy memberships of one layer's pixels."""
    low, middle, high = fuzzy_three(F.col("c0"), c, w)
    return pixel_rows(images, key, image, 1).groupBy(key).agg(F.sum(low).alias("low"), F.sum(middle).alias("middle"), F.sum(high).alias("high"))


def array_of(image: dict) -> np.ndarray:
    data = np.asarray(image["data"], float).reshape(image["y"], image["x"], image["z"])
    return data[:, :, 0] if image["z"] == 1 else data


def on_images(images: DataFrame, key: str, image: str, f: Callable[[np.ndarray], np.ndarray], alias: str) -> DataFrame:
    """(key, alias): a numpy feature of each image as an array of doubles, over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], alias: [np.asarray(f(array_of(x.asDict() if hasattr(x, "asDict") else x)), float).ravel().tolist() for x in batch[image]]})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, image).mapInPandas(run, f"`{key}` {kind}, `{alias}` array<double>")


def tamura(images: DataFrame, key: str, image: str, steps: int = 8) -> DataFrame:
    return on_images(images, key, image, lambda x: imaging.tamura(x, steps), "tamura")


def gabor(images: DataFrame, key: str, image: str, phases: int = 4, frequencies: int = 3) -> DataFrame:
    return on_images(images, key, image, lambda x: imaging.gabor(x, phases, frequencies), "gabor")


def invariant(images: DataFrame, key: str, image: str, kernel: str = "monomial") -> DataFrame:
    return on_images(images, key, image, lambda x: imaging.invariant(x, kernel=kernel), "invariant")


def tamura_pairs(images: DataFrame, key: str, image: str, sizes: list[float], steps: int = 4) -> DataFrame:
    """(key, pairs): the histogram of the image, then for each centre window its own and the background's, in one flat array."""

    def run(x: np.ndarray) -> np.ndarray:
        complete, windows = imaging.histogram_pairs(x, sizes, lambda w: imaging.tamura(w, steps))
        return np.concatenate([complete, *[part for w in windows for part in (w, complete - w)]])

    return on_images(images, key, image, run, "pairs")


def sparse_gabor(images: DataFrame, key: str, image: str, phases: int = 2, frequencies: int = 2, steps: int = 4) -> DataFrame:
    """(key, bin, n): Gabor means and deviations counted by the string of their positions between the table's bounds."""
    vectors = gabor(images, key, image, phases, frequencies)
    return sparse_histogram(vectors, [key], "gabor", sparse_bounds(vectors, "gabor"), steps)


def kernel_histogram(images: DataFrame, key: str, image: str, points: list[tuple[float, float]], rotations: int = 36) -> DataFrame:
    """Invariant histogram of the geometric mean of pixel values at one, two or three points."""
    return on_images(images, key, image, lambda x: imaging.invariant(x, points, rotations), "invariant")


def local_features(images: DataFrame, key: str, image: str, method: str = "grid", n: int = 3, radius: int = 2, descriptor: str = "patch") -> DataFrame:
    """(key, x, y, s, v): one row for each local feature; points of a grid, at random (seed 0) or of difference-of-Gaussian extrema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, image_ in zip(batch[key], batch[image], strict=True):
                x = array_of(image_)
                if method == "grid":
                    points = imaging.grid_points(x.shape, n)
                elif method == "random":
                    points = imaging.random_points(x.shape, n)
                else:
                    points = [(p[0], p[1]) for p in imaging.dog_points(x, n)] or [(x.shape[0] // 2, x.shape[1] // 2)]
                rows += [(k, *f) for f in imaging.local_features(x, points, radius, descriptor)]
            yield pd.DataFrame(rows, columns=[key, "x", "y", "s", "v"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, image).mapInPandas(run, f"`{key}` {kind}, x int, y int, s int, v array<double>")


def sparse_bounds(vectors: DataFrame, column: str, mode: str = "minmax", a: float = 1.25) -> DataFrame:
    """(d, low, high): bounds of each dimension, its least and largest value or its mean -+ ``a`` standard deviations."""
    x = vectors.select(F.posexplode(column).alias("d", "x")).groupBy("d")
    if mode == "minmax":
        return x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return x.agg((F.avg("x") - F.lit(a) * F.stddev_pop("x")).alias("low"), (F.avg("x") + F.lit(a) * F.stddev_pop("x")).alias("high"))


def sparse_histogram(vectors: DataFrame, keys: list[str], column: str, bounds: DataFrame, steps: int) -> DataFrame:
    """(keys, bin, n): vectors counted by the string of their positions between the bounds."""
    limits = bounds.agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("b"))  # as many as dimensions
    met = vectors.crossJoin(F.broadcast(limits))
    at = F.zip_with(column, "b", lambda x, b: F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((x - b["low"]) / F.nullif((b["high"] - b["low"]) / F.lit(float(steps)), F.lit(0.0))))))
    code = F.array_join(F.transform(at, lambda p: F.char(F.lit(48) + F.coalesce(p, F.lit(0)))), "")
    return met.groupBy(*keys, code.alias("bin")).agg(F.count("*").alias("n"))


def _pair_feature(pairs: DataFrame, keys: list[str], f: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """(keys, d) of rows (keys, a, b) with images or local-feature matrices, over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["d"] = [f(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield out

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "a", "b").mapInPandas(run, f"{kinds}, d double")


def _matrix(x) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in x]) if len(x) else np.empty((0, 1))


def image_distortion(pairs: DataFrame, keys: list[str], warp: int = 3, context: int = 1, cut: float = 0.05) -> DataFrame:
    return _pair_feature(pairs, keys, lambda a, b: imaging.image_distortion(array_of(b), array_of(a), warp, context, cut))


def cross_correlation(pairs: DataFrame, keys: list[str], reach: int = 4) -> DataFrame:
    return _pair_feature(pairs, keys, lambda a, b: imaging.cross_correlation(array_of(b), array_of(a), reach))


def edge_cover(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _pair_feature(pairs, keys, lambda a, b: imaging.edge_cover(_matrix(a), _matrix(b)))


def earth_mover(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signatures are arrays of (weight, v)."""
    split = lambda s: (np.array([x["weight"] for x in s], float), _matrix([x["v"] for x in s]))

    def f(a, b) -> float:
        (wa, va), (wb, vb) = split(a), split(b)
        return imaging.earth_mover(va, wa, vb, wb)

    return _pair_feature(pairs, keys, f)


def local_hits(local: DataFrame, queries: DataFrame, column: str, k: int) -> DataFrame:
    """(q, idx, d): all hits of a query minus those of the object among the ``k`` nearest stored features of each query feature.

    ``local`` has (idx, column), ``queries`` (q, f, column); few query features are broadcast, and ranking is a partial top-k per task.
    """
    from pyspark.sql import Window

    d = local.select("idx", F.col(column).alias("a")).crossJoin(few(queries.select("q", "f", F.col(column).alias("b"))))
    d = d.select("q", "f", "idx", F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("q", "f").orderBy("d", "idx"))).where(F.col("r") <= k)
    hits = near.groupBy("q", "idx").agg(F.count("*").alias("hits"))
    every = local.select("idx").distinct().crossJoin(few(queries.select("q").distinct()))
    totals = hits.groupBy("q").agg(F.sum("hits").alias("total"))
    return every.join(totals, "q").join(hits, ["q", "idx"], "left").select("q", "idx", (F.col("total") - F.coalesce("hits", F.lit(0))).cast("double").alias("d"))
