"""Re-ranking of result lists and learned relevance feedback.

Result lists are cut to a window of the best ``consider`` before anything pairwise is done, so each query's group has a fixed size;
groups run in parallel as pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import ranked


def _grouped(results: DataFrame, objects: DataFrame, column: str, consider: int, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` on the best ``consider`` rows (qid, idx, score, v) of each query, in order of rank; returns (qid, idx, score)."""
    window = ranked(results, 1, consider).join(objects.select("idx", F.col(column).alias("v")), "idx").select("qid", "idx", "score", "rank", "v")
    kinds = ", ".join(f"{c} {results.schema[c].dataType.simpleString()}" for c in ("qid", "idx"))
    return window.groupBy("qid").applyInPandas(lambda pdf: f(pdf.sort_values("rank"))[["qid", "idx", "score"]], f"{kinds}, score double")


def pairwise(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2), 0))


def similarity(scores: np.ndarray) -> np.ndarray:
    """1 - (-ln s) / max: 1 for the best, 0 for the worst."""
    d = -np.log(np.maximum(scores, 1e-300))
    return 1 - d / d.max() if d.max() > 0 else np.ones_like(d)


def greedy_order(scores: np.ndarray, v: np.ndarray, alpha: float, n: int) -> list[int]:
    """Maximal marginal relevance: alpha similarity plus (1 - alpha) mean dissimilarity to what is chosen."""
    sim, far = similarity(scores), pairwise(v)
    far = far / far.max() if far.max() > 0 else far
    chosen: list[int] = []
    sums = np.zeros(len(v))
    while len(chosen) < min(n, len(v)):
        value = alpha * sim + ((1 - alpha) * sums / len(chosen) if chosen else 0)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        sums += far[chosen[-1]]
    return chosen


def sequence_order(scores: np.ndarray, v: np.ndarray, n: int, scale: float, last_only: bool = False, monotone: bool = False) -> list[int]:
    """Dynamic program over positions: scaled similarity plus novelty against the path so far (its last item, or the nearest of it).

    Every state keeps the best path that ends in an item; ``monotone`` allows only paths that go down the old ranking.
    """
    sim, far = similarity(scores), pairwise(v)
    far = far / far.max() if far.max() > 0 else far
    k = min(n, len(v))
    value, paths = scale * sim, [[i] for i in range(len(v))]
    for position in range(1, k):
        new_value, new_paths = np.full(len(v), -np.inf), [[] for _ in v]
        for i in range(len(v)):
            for j in range(i if monotone else len(v)):
                if i == j or not np.isfinite(value[j]) or i in paths[j]:
                    continue
                novelty = far[i, j] if last_only else min(far[i, x] for x in paths[j])
                total = value[j] + scale * sim[i] + novelty
                if total > new_value[i]:
                    new_value[i], new_paths[i] = total, [*paths[j], i]
        if not np.isfinite(new_value).any():
            break
        value, paths = new_value, new_paths
    best = paths[int(np.argmax(value))]
    return best + [i for i in range(len(v)) if i not in best]


def _in_order(pdf: pd.DataFrame, order: list[int]) -> pd.DataFrame:
    """Scores above the window's best, falling with the new position."""
    out = pdf.iloc[order].copy()
    out["score"] = pdf["score"].max() + 1 / (np.arange(len(out)) + 1)
    return pd.concat([out, pdf.drop(pdf.index[order])])


def greedy(results: DataFrame, objects: DataFrame, column: str, consider: int = 100, alpha: float = 0.8, n: int = 20) -> DataFrame:
    return _grouped(results, objects, column, consider, lambda p: _in_order(p, greedy_order(p["score"].to_numpy(), np.stack(p["v"].to_numpy()), alpha, n)))


def dynamic(results: DataFrame, objects: DataFrame, column: str, consider: int = 20, scale: float = 1.0, last_only: bool = True, n: int = 10) -> DataFrame:
    return _grouped(results, objects, column, consider, lambda p: _in_order(p, sequence_order(p["score"].to_numpy(), np.stack(p["v"].to_numpy()), n, scale, last_only)))


def monotone(results: DataFrame, objects: DataFrame, column: str, consider: int = 20, scale: float = 1.0, n: int = 10) -> DataFrame:
    return _grouped(results, objects, column, consider, lambda p: _in_order(p, sequence_order(p["score"].to_numpy(), np.stack(p["v"].to_numpy()), n, scale, True, True)))


def by_cluster(results: DataFrame, clusters: DataFrame, consider: int = 100, alpha: float = 1.0, k: int = 8) -> DataFrame:
    """Bonus alpha (1 - earlier results of the same cluster / (earlier results x k)) in order of rank; clusters are (idx, cluster)."""
    window = ranked(results, 1, consider).join(clusters, "idx")
    same = F.count("*").over(Window.partitionBy("qid", "cluster").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    bonus = F.lit(alpha) * (F.lit(1.0) - same / F.nullif((F.col("rank") - 1) * F.lit(k), F.lit(0)))
    return window.select("qid", "idx", (F.col("score") + F.coalesce(bonus, F.lit(alpha))).alias("score"))


# Learned feedback: few example rows reach the driver, weights go back as literals.


def examples(objects: DataFrame, queries: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the positive and of the negative examples of one query."""
    rows = objects.select("idx", F.col(column).alias("v")).join(F.broadcast(queries), "idx").select("sign", "v", "idx").orderBy("idx").collect()
    take = lambda s: np.array([r["v"] for r in rows if r["sign"] == s], float).reshape(sum(r["sign"] == s for r in rows), -1)
    return take(1), take(-1)


def tune_weighted_l1(pos: np.ndarray, neg: np.ndarray, iterations: int = 100, step: float = 0.1, regularization: float = 0.0) -> np.ndarray:
    """Non-negative weights that lower, by gradient descent, the ratio of each positive's nearest positive to its nearest negative; ones with fewer than two of either."""
    dims = pos.shape[1] if len(pos) else neg.shape[1]
    w = np.ones(dims)
    if len(pos) < 2 or len(neg) < 2:
        return w
    for _ in range(iterations):
        gradient = np.zeros(dims)
        for i, x in enumerate(pos):
            near = np.abs(np.delete(pos, i, axis=0) - x)
            far = np.abs(neg - x)
            a, b = near[np.argmin(near @ w)], far[np.argmin(far @ w)]
            da, db = max(a @ w, 1e-12), max(b @ w, 1e-12)
            gradient += (a * db - b * da) / db**2
        w = np.maximum(w - step * (gradient / len(pos) + regularization * (w - 1)), 0)
        w *= dims / max(w.sum(), 1e-12)
    return w


def tune_dimension_weights(pos: np.ndarray, neg: np.ndarray, iterations: int = 100, ramp: float = 10.0) -> np.ndarray:
    """Weights of squared differences that push a sigmoid of the same ratio of squared distances down; ones with fewer than two positives or no negatives."""
    w = np.ones(pos.shape[1])
    if len(pos) < 2 or not len(neg):
        return w
    for _ in range(iterations):
        gradient = np.zeros_like(w)
        for i, x in enumerate(pos):
            near, far = (np.delete(pos, i, axis=0) - x) ** 2, (neg - x) ** 2
            a, b = near[np.argmin(near @ w)], far[np.argmin(far @ w)]
            da, db = max(a @ w, 1e-12), max(b @ w, 1e-12)
            s = 1 / (1 + np.exp(-ramp * np.clip(da / db - 1, -50, 50)))
            gradient += ramp * s * (1 - s) * (a * db - b * da) / db**2
        w = np.maximum(w - 0.1 * gradient / len(pos), 1e-6)
        w *= len(w) / w.sum()
    return w


def tune_class_weights(pos: np.ndarray, neg: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray]:
    """Separate weights for distances to positives and to negatives."""
    return tune_dimension_weights(pos, neg, **options), tune_dimension_weights(neg, pos, **options)


def tune_query_weights(distances: np.ndarray, signs: np.ndarray, iterations: int = 100, step: float = 0.1) -> np.ndarray:
    """One weight for each query object from the square matrix of distances among them: objects far from others of their sign and near to the other sign count less."""
    w = np.ones(len(signs))
    for _ in range(iterations):
        same = (distances * (signs[:, None] == signs[None, :])).sum(axis=1) / np.maximum((signs[:, None] == signs[None, :]).sum(axis=1) - 1, 1)
        other = (distances * (signs[:, None] != signs[None, :])).sum(axis=1) / np.maximum((signs[:, None] != signs[None, :]).sum(axis=1), 1)
        w = np.maximum(w * np.exp(-step * (same - other)), 1e-6)
        w *= len(w) / w.sum()
    return w
