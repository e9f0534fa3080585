"""Clustering, pooling, projections and classification.

Models are small tables of Gaussians (cluster, elements, mean, sigma). Each iteration of a fit is one job: assign every row
to the nearest of the broadcast centres inside the JVM, then aggregate by cluster and dimension with map-side partial sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import argmin, total
from lodestar.operators.steps import written

SIGMA_FLOOR = 1e-8
MODEL = "cluster int, elements long, mean array<double>, sigma array<double>"


def _literal(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def squared_distances(v: Column, means: np.ndarray, sigmas: np.ndarray | None = None) -> Column:
    """Array of squared L2 distances to each mean, or Mahalanobis distances plus the log norm of diagonal Gaussians."""
    if sigmas is None:
        return F.transform(_literal(means), lambda m: total(F.zip_with(v, m, lambda x, y: (x - y) * (x - y))))
    sigmas = np.maximum(sigmas, SIGMA_FLOOR)
    norms = np.log(2 * np.pi * sigmas).sum(axis=1)
    models = F.array(*[F.struct(_literal(m[None, :])[0].alias("m"), _literal(s[None, :])[0].alias("s"), F.lit(float(n)).alias("n")) for m, s, n in zip(means, sigmas, norms, strict=True)])
    return F.transform(models, lambda g: g["n"] + total(F.zip_with(F.zip_with(v, g["m"], lambda x, y: (x - y) * (x - y)), g["s"], lambda d, s: d / s)))


def assign(rows: DataFrame, column: str, means: np.ndarray, sigmas: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``cluster``, the nearest centre (the first of equals)."""
    return rows.withColumn("cluster", argmin(squared_distances(F.col(column), means, sigmas)))


def reestimate(assigned: DataFrame, column: str) -> DataFrame:
    """(cluster, d, n, mean, variance) by cluster and dimension."""
    x = assigned.select("cluster", F.posexplode(column).alias("d", "x"))
    return x.groupBy("cluster", "d").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(0.0)).alias("variance"))


def pooled(stats: DataFrame, mode: str) -> DataFrame:
    """Variances pooled over clusters (``cluster``), dimensions (``dimension``), both (``both``) or not (``none``), weighted by counts."""
    keys = {"none": ["cluster", "d"], "cluster": ["d"], "dimension": ["cluster"], "both": []}[mode]
    return stats.groupBy(*keys).agg((F.sum(F.col("n") * F.col("variance")) / F.sum("n")).alias("variance"))


def _model(stats: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and variances by cluster, as driver arrays: as many rows as clusters and dimensions."""
    rows = stats.collect()
    ids = sorted({r["cluster"] for r in rows})
    place = {c: i for i, c in enumerate(ids)}
    n, mean, var = np.zeros(len(ids)), np.zeros((len(ids), dims)), np.zeros((len(ids), dims))
    for r in rows:
        i = place[r["cluster"]]
        n[i], mean[i, r["d"]], var[i, r["d"]] = r["n"], r["mean"], r["variance"]
    return n, mean, var


def fit_splitting(rows: DataFrame, column: str, splits: int = 3, iterations: int = 5, mode: str = "all", disturb: float = 0.1, least: int = 1, pooling: str = "none", mahalanobis: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and variances of Gaussians grown by splitting.

    Starts from one Gaussian over all rows; each split doubles all clusters (``all``), that of the most elements (``largest``) or of the
    largest variance (``variance``) by moving the mean up and down by ``disturb`` standard deviations; then rows are reassigned
    ``iterations`` times. Clusters of fewer than ``least`` rows are deleted. Variances are pooled as told.
    """
    dims = rows.select(F.size(column)).head()[0]
    rows = rows.select(column).persist()
    try:
        n, mean, var = _model(reestimate(rows.withColumn("cluster", F.lit(0)), column), dims)
        for _ in range(splits):
            pick = range(len(n)) if mode == "all" else [int(np.argmax(n if mode == "largest" else var.sum(axis=1)))]
            step = disturb * np.sqrt(np.maximum(var, SIGMA_FLOOR))
            kept = [i for i in range(len(n)) if i not in pick]
            mean = np.concatenate([mean[kept], *[np.stack([mean[i] + step[i], mean[i] - step[i]]) for i in pick]])
            var = np.concatenate([var[kept], *[np.stack([var[i], var[i]]) for i in pick]])
            for _ in range(iterations):
                n, mean, var = _model(reestimate(assign(rows, column, mean, var if mahalanobis else None), column), dims)
                good = n >= least
                n, mean, var = n[good], mean[good], np.maximum(var[good], SIGMA_FLOOR)
                if pooling in ("cluster", "both"):
                    var = np.broadcast_to((n[:, None] * var).sum(axis=0) / n.sum(), var.shape).copy()
                if pooling in ("dimension", "both"):
                    var = np.broadcast_to(var.mean(axis=1, keepdims=True), var.shape).copy()
        return n, mean, var
    finally:
        rows.unpersist()


def visual_words(local: DataFrame, keys: list[str], column: str, means: np.ndarray, alpha: float | None = None) -> DataFrame:
    """(keys, bin, n): histogram of nearest centres, or with ``alpha`` of fuzzy memberships exp(-(d - least) / alpha), each summing to 1."""
    if alpha is None:
        return assign(local, column, means).groupBy(*keys, F.col("cluster").alias("bin")).agg(F.count("*").alias("n"))
    d = local.select(*keys, squared_distances(F.col(column), means).alias("d"))
    w = d.select(*keys, F.transform("d", lambda x: F.exp(-(x - F.array_min("d")) / F.lit(alpha))).alias("w"))
    e = w.select(*keys, F.posexplode(F.transform("w", lambda x: x / total(F.col("w")))).alias("bin", "x"))
    return e.groupBy(*keys, "bin").agg(F.sum("x").alias("n"))


def cluster_positions(local: DataFrame, keys: list[str], column: str, means: np.ndarray) -> DataFrame:
    """(keys, x, y, ids): the clusters met at each position."""
    return assign(local, column, means).groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_set("cluster")).alias("ids"))


#: Vectors of one pack, and vectors of each side of a task where packs meet, at most.
PACK, SIDE = 4096, 65_536
#: Distances that a task computes at once.
AT_ONCE = 1 << 21


class _Links:
    """Least members of linked numbers, by union of many pairs at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.of, high, low)
            while (self.of != self.of[self.of]).any():
                self.of = self.of[self.of]


def _near(a: np.ndarray, b: np.ndarray, epsilon: float) -> np.ndarray:
    """Whether squared distances of rows are at most ``epsilon``: by products, and by sums in order of dimensions where those are too close to tell."""
    left, right = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = a @ b.T
    d *= -2.0
    d += left[:, None]
    d += right[None, :]
    slack = 1e-14 * (8 + a.shape[1]) * (left.max() + right.max() + abs(epsilon))
    near = d <= epsilon - slack
    i, j = np.nonzero((d <= epsilon + slack) & ~near)
    exact = np.zeros(len(i))
    for k in range(a.shape[1]):
        exact += (a[i, k] - b[j, k]) ** 2
    near[i, j] = exact <= epsilon
    return near


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of a box and others."""
    return (np.maximum(np.maximum(low - highs, lows - high), 0.0) ** 2).sum(axis=1)


def _packed(rows: DataFrame, column: str, epsilon: float, name: str, value: str | None = None) -> DataFrame:
    """The vectors as a written table of packs, near ones together; those that are null or hold null or non-finite components take no part."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def pack_of(ids: np.ndarray, values: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            cells = [[number], [len(x)], [x.shape[1]], [x.min(axis=0).tolist()], [x.max(axis=0).tolist()], [ids.tobytes()], [values.tobytes()], [x.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["pack", "rows", "dims", "low", "high", "ids", "labels", "data"])

        kept: dict[int, list] = {}
        for batch in batches:
            v = batch.column("v")
            sizes, data = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            starts = v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
            ids, values = batch.column("idx").to_numpy(), batch.column("label").to_numpy()
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                now = [ids[at], values[at], data[starts[at][:, None] + np.arange(dims)] if dims else np.empty((len(at), 0))]
                now = [np.concatenate(x) for x in zip(kept[dims], now, strict=True)] if dims in kept else now
                while len(now[0]) >= PACK:
                    yield pack_of(*(x[:PACK] for x in now))
                    now = [x[PACK:] for x in now]
                kept[dims] = now
        for now in kept.values():
            if len(now[0]):
                yield pack_of(*now)

    label = F.lit(0) if value is None else F.col(value)
    x = rows.select(F.col("idx").cast("long").alias("idx"), F.col(column).cast("array<double>").alias("v"), label.cast("long").alias("label"))
    x = x.where(F.col("v").isNotNull() & F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))
    cells = [F.floor(F.get("v", F.lit(d)) / F.lit(max(epsilon**0.5, 1e-9))) for d in (0, 1)]
    dealt = x.repartitionByRange(max(1, -(-x.count() // PACK)), *cells).sortWithinPartitions(*cells)
    return written(dealt.mapInArrow(run, "pack long, rows long, dims int, low array<double>, high array<double>, ids binary, labels binary, data binary"), name)


def _meetings(left: DataFrame, right: DataFrame | None, epsilon: float, mode: str) -> DataFrame:
    """(idx, x) of packs that meet, some rows for an idx. ``count``: vectors within ``epsilon``; ``links``: a member of the same component; ``least``: the least label of the right ones.

    Without ``right``, packs meet those of the same table, each pair once. Packs whose boxes are too far apart don't meet.
    """
    import pyarrow as pa

    spark = left.sparkSession
    boxes = [[(r["pack"], r["rows"], r["dims"], np.array(r["low"]), np.array(r["high"])) for r in t.select("pack", "rows", "dims", "low", "high").orderBy("pack").collect()] for t in ([left] if right is None else [left, right])]
    reach = epsilon * (1 + 1e-9) + 1e-300

    def grouped(packs: list) -> list[list]:
        side = min(SIDE, max(PACK // 8, -(-sum(p[1] for p in packs) // max(1, round((4 * spark.sparkContext.defaultParallelism) ** 0.5)))))
        out: list[list] = []
        for dims in sorted({p[2] for p in packs}):
            n = side
            for p in packs:
                if p[2] == dims:
                    if n + p[1] > side:
                        out.append([])
                        n = 0
                    out[-1].append(p)
                    n += p[1]
        return out

    groups = [grouped(packs) for packs in boxes]
    others = groups[-1]
    found, task = [], 0
    spans = [(g[0][2], np.min([p[3] for p in g], axis=0), np.max([p[4] for p in g], axis=0)) for g in others]
    for i, g in enumerate(groups[0]):
        low, high = np.min([p[3] for p in g], axis=0), np.max([p[4] for p in g], axis=0)
        for j in range(i if right is None else 0, len(others)):
            if spans[j][0] == g[0][2] and _apart(low, high, spans[j][1][None], spans[j][2][None])[0] <= reach:
                found += [(p[0], task, 0) for p in g] + [(p[0], task, 1) for p in others[j] if not (right is None and i == j)]
                task += 1

    def run(table: pa.Table) -> pa.Table:
        sides: list[list] = [[], []]
        for r in sorted(table.to_pylist(), key=lambda r: r["pack"]):
            x = np.frombuffer(r["data"]).reshape(r["rows"], r["dims"])
            sides[r["side"]].append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), x))
        alone = not sides[1]
        ids = [np.concatenate([np.empty(0, np.int64), *(p[0] for p in s)]) for s in sides]
        links, n, low = _Links(len(ids[0]) + len(ids[1])), np.zeros(len(ids[0]) + len(ids[1]), np.int64), np.full(len(ids[0]), np.iinfo(np.int64).max)
        at = 0
        for _, _, a in sides[0]:
            to = 0 if alone else len(ids[0])
            for _, labels, b in sides[0] if alone else sides[1]:
                step = max(1, AT_ONCE // len(b))
                for k in range(0, len(a) if _apart(a.min(axis=0), a.max(axis=0), b.min(axis=0)[None], b.max(axis=0)[None])[0] <= reach else 0, step):
                    near, rows = _near(a[k : k + step], b, epsilon), slice(at + k, at + min(k + step, len(a)))
                    if mode == "count":
                        n[rows] += near.sum(axis=1)
                        if not alone:
                            n[to : to + len(b)] += near.sum(axis=0)
                    elif mode == "links":
                        i, j = np.nonzero(near)
                        links.add(i + at + k, j + to)
                    else:
                        low[rows] = np.minimum(low[rows], np.where(near, labels, np.iinfo(np.int64).max).min(axis=1))
                to += len(b)
            at += len(a)
        every = np.concatenate(ids)
        if mode == "least":
            some = low < np.iinfo(np.int64).max
            return pa.table({"idx": ids[0][some], "x": low[some]})
        if mode == "links":
            some = links.of != np.arange(len(every))
            return pa.table({"idx": every[some], "x": every[links.of[some]]})
        return pa.table({"idx": every[n > 0], "x": n[n > 0]})

    names = spark.createDataFrame(found, "pack long, task int, side int")
    columns = ["pack", "rows", "dims", "ids", "labels", "data"]
    dealt = [t.select(*columns).join(F.broadcast(names if right is None else names.where(f"side = {i}")), "pack") for i, t in enumerate([left] if right is None else [left, right])]
    both = dealt[0] if right is None else dealt[0].unionByName(dealt[1])
    return both.repartition(max(1, 4 * task), "task").groupBy("task").applyInArrow(run, "idx long, x long")


def neighbour_counts(rows: DataFrame, column: str, epsilon: float, least: int) -> DataFrame:
    """(idx, n, core): rows within squared distance ``epsilon``, itself included, and whether they are at least ``least``.

    Packs of vectors meet by matrix products, those too far apart left out; distances too close to ``epsilon`` are summed exactly as in SQL.
    """
    return _counted(_packed(rows, column, epsilon, "near-packs"), epsilon, least)


def _counted(packs: DataFrame, epsilon: float, least: int) -> DataFrame:
    return _meetings(packs, None, epsilon, "count").groupBy("idx").agg(F.sum("x").alias("n")).withColumn("core", F.col("n") >= least)


def dbscan(rows: DataFrame, column: str, epsilon: float, least: int) -> DataFrame:
    """(idx, cluster): density clusters named by their smallest core id; noise is null. Border rows join the smallest.

    Each meeting of packs of cores gives a link for each core at most. Least labels spread along these links and jump to their
    label's label, until none changes; each round is a written table.
    """
    packs = _packed(rows, column, epsilon, "dbscan-packs")
    counts = written(_counted(packs, epsilon, least).where("core").select("idx"), "dbscan-cores")
    cores = rows.join(counts, "idx", "left_semi")
    links = _meetings(_packed(cores, column, epsilon, "dbscan-core-packs"), None, epsilon, "links").toDF("i", "j")
    links = written(links.union(links.select("j", "i")).union(counts.select("idx", "idx")).distinct(), "dbscan-links")
    labels = counts.withColumn("cluster", F.col("idx"))
    while True:
        near = links.join(labels.withColumnRenamed("idx", "j"), "j").groupBy(F.col("i").alias("idx")).agg(F.min("cluster").alias("near"))
        jump = labels.select(F.col("idx").alias("cluster"), F.col("cluster").alias("next"))
        moved = labels.join(near, "idx").select("idx", F.col("cluster").alias("was"), F.least("cluster", "near").alias("cluster")).join(jump, "cluster").select("idx", "was", F.least("cluster", "next").alias("cluster"))
        moved = written(moved, "dbscan-labels")
        labels = moved.select("idx", "cluster")
        if moved.where("was <> cluster").limit(1).count() == 0:
            break
    others = _packed(rows.join(counts, "idx", "left_anti"), column, epsilon, "dbscan-other-packs")
    named = _packed(cores.join(labels, "idx"), column, epsilon, "dbscan-named-packs", "cluster")
    border = _meetings(others, named, epsilon, "least").groupBy("idx").agg(F.min("x").alias("cluster"))
    return rows.select("idx").join(labels.unionByName(border), "idx", "left")


def moments(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and the Gram matrix of an array column: each task adds up its batches and gives one row."""
    import pyarrow as pa

    def run(batches):
        n, total, gram = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                total, gram = (x.sum(axis=0), x.T @ x) if gram is None else (total + x.sum(axis=0), gram + x.T @ x)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], names=["n", "total", "gram"])

    parts = rows.select(F.col(column).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "n long, total array<double>, gram array<double>")
    n = parts.agg(F.sum("n")).head()[0] or 0

    def added(name: str) -> np.ndarray:
        return np.array([r["x"] for r in parts.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])

    total = added("total")
    return int(n), total, added("gram").reshape(len(total), len(total))


def covariance(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance, from one Gram matrix for each task."""
    n, total, gram = moments(rows, column)
    mean = total / max(n, 1)
    return n, mean, gram / max(n, 1) - np.outer(mean, mean)


def svd(rows: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values of the matrix of all rows and its right singular vectors (as rows), by the Gram matrix.

    The left vectors are the rows' projections divided by the values: ``project`` with a mean of zero.
    """
    _, _, gram = moments(rows, column)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0.0)), vectors[:, order].T


def pca(rows: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``k`` leading eigenvectors (rows) and their eigenvalues."""
    _, mean, cov = covariance(rows, column)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return mean, vectors[:, order].T, values[order]


def project(v: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    centred = F.zip_with(v, F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    return F.transform(_literal(axes), lambda a: total(F.zip_with(centred, a, lambda x, y: x * y)))


def back_project(p: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    parts = F.transform(_literal(axes.T), lambda a: total(F.zip_with(p, a, lambda x, y: x * y)))
    return F.zip_with(parts, F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x + m)


def lda(rows: DataFrame, column: str, label: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``k`` axes of largest ratio of between-class to within-class scatter."""
    n, mean, cov = covariance(rows, column)
    groups = rows.select(F.col(label).alias("c"), F.posexplode(column).alias("d", "x")).groupBy("c", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()
    between = np.zeros_like(cov)
    for c in {g["c"] for g in groups}:
        own = sorted((g["d"], g["n"], g["m"]) for g in groups if g["c"] == c)
        gap = np.array([m for _, _, m in own]) - mean
        between += own[0][1] / n * np.outer(gap, gap)
    within = cov - between + SIGMA_FLOOR * np.eye(len(cov))
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    order = np.argsort(-values.real)[:k]
    return mean, vectors.real[:, order].T


def gaussian_log_density(v: Column, mean: np.ndarray, sigma: np.ndarray) -> Column:
    """Log density of a diagonal Gaussian."""
    return F.lit(-0.5) * squared_distances(v, mean[None, :], sigma[None, :])[0]


def fit_linear_svm(rows: DataFrame, column: str, label: Column, iterations: int = 100, regularization: float = 0.01):
    """Linear support vector machine on (vector, label) rows: weights and intercept."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    fitted = LinearSVC(maxIter=iterations, regParam=regularization).fit(rows.select(array_to_vector(column).alias("features"), label.cast("double").alias("label")))
    return np.array(fitted.coefficients), float(fitted.intercept)


# Per-object models and classifiers.


def signatures(local: DataFrame, key: str, column: str, splits: int = 2, iterations: int = 5) -> DataFrame:
    """(key, cluster, count, mean, sigma): the local vectors of each object clustered on their own, empty clusters left out.

    An object's local features are few; objects run in parallel.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf[column].tolist(), float)
        means = x.mean(axis=0, keepdims=True)
        for _ in range(splits):
            step = 0.1 * x.std(axis=0) + 1e-4
            means = np.concatenate([means + step, means - step])
            for _ in range(iterations):
                at = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
                means = np.array([x[at == c].mean(axis=0) for c in np.unique(at)])
        at = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        rows = [(pdf[key].iloc[0], c, int((at == c).sum()), x[at == c].mean(axis=0).tolist(), np.maximum(x[at == c].var(axis=0), SIGMA_FLOOR).tolist()) for c in np.unique(at)]
        return pd.DataFrame(rows, columns=[key, "cluster", "count", "mean", "sigma"])

    kind = local.schema[key].dataType.simpleString()
    return local.select(key, column).groupBy(key).applyInPandas(run, f"`{key}` {kind}, cluster int, count long, mean array<double>, sigma array<double>")


def position_clusters(points: DataFrame, key: str, splits: int = 2, iterations: int = 5, floor: float = 1e-2) -> DataFrame:
    """(key, cluster, count, mean, covariance) of each object's (x, y): full-covariance clusters split along their main axis, eigenvalues not below ``floor``."""
    import pandas as pd

    def fit(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cov = np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((2, 2))
        values, vectors = np.linalg.eigh(cov)
        return p.mean(axis=0), vectors @ np.diag(np.maximum(values, floor)) @ vectors.T

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        models, at = [fit(p)], np.zeros(len(p), int)
        for _ in range(splits):
            halves = []
            for m, c in models:
                values, vectors = np.linalg.eigh(c)
                step = vectors[:, -1] * np.sqrt(values[-1]) / 2
                halves += [(m + step, c), (m - step, c)]
            models = halves
            for _ in range(iterations):
                cost = np.stack([np.einsum("ni,ij,nj->n", p - m, np.linalg.inv(c), p - m) + np.log(np.linalg.det(c)) for m, c in models], axis=1)
                at = cost.argmin(axis=1)
                models = [fit(p[at == i]) for i in np.unique(at)]
                at = np.unique(at, return_inverse=True)[1]
        rows = [(pdf[key].iloc[0], i, int((at == i).sum()), m.tolist(), c.ravel().tolist()) for i, (m, c) in enumerate(models)]
        return pd.DataFrame(rows, columns=[key, "cluster", "count", "mean", "covariance"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "x", "y").groupBy(key).applyInPandas(run, f"`{key}` {kind}, cluster int, count long, mean array<double>, covariance array<double>")


def class_gaussians(rows: DataFrame, column: str, label: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their priors, means and diagonal variances, from one aggregate by class and dimension."""
    stats = rows.select(F.col(label).alias("cluster"), column)
    found = reestimate(stats, column).collect()
    classes = sorted({r["cluster"] for r in found})
    dims = 1 + max(r["d"] for r in found)
    mean, var, n = np.zeros((len(classes), dims)), np.zeros((len(classes), dims)), np.zeros(len(classes))
    for r in found:
        i = classes.index(r["cluster"])
        mean[i, r["d"]], var[i, r["d"]], n[i] = r["mean"], max(r["variance"], SIGMA_FLOOR), r["n"]
    return classes, n / n.sum(), mean, var


def classify_gaussian(rows: DataFrame, column: str, model: tuple[list, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``rows`` with ``prediction``, the class of the largest prior times density."""
    classes, prior, mean, var = model
    cost = F.zip_with(squared_distances(F.col(column), mean, var), F.array(*[F.lit(float(-2 * np.log(p))) for p in prior]), lambda d, p: d + p)
    return rows.withColumn("prediction", F.get(F.array(*map(F.lit, classes)), argmin(cost)))


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the key; the same rows always fall in the same part."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))
    return rows.where(at), rows.where(~at)


def reconstruction_map(image: np.ndarray, mean: np.ndarray, axes: np.ndarray, height: int, width: int) -> np.ndarray:
    """For every position the error of its patch after projection on ``axes``, scaled to [0, 1]: low where the patch is like the training set."""
    windows = np.lib.stride_tricks.sliding_window_view(image, (height, width))
    flat = windows.reshape(*windows.shape[:2], -1) - mean
    error = (flat**2).sum(axis=2) - ((flat @ axes.T) ** 2).sum(axis=2)
    low, high = error.min(), error.max()
    return (error - low) / (high - low) if high > low else np.zeros_like(error)
