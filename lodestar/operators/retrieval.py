"""Retrieval: distances of all objects to query objects, normalisation, scores, combination and ranking.

All queries of a batch run as one lazy plan. ``queries`` has the columns (qid, idx, sign): the stored objects that are
positive (+1) or negative (-1) examples of each query. Query objects are few against the stored ones; they
are broadcast after a check of their number, and beyond it a shuffled cross of query blocks does the same.

Per query object the mean distance is an aggregate with map-side partial sums, joined back as a small
table: no window gathers all objects of a query in one task. Ranking filters on ``row_number``, which Spark turns into
a partial top-k in every task before rows are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.steps import few as _few, written

Feature = tuple[str, Callable[[Column, Column], Column]]


def resolve_names(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, idx, sign) of queries given by ``name``; unknown names are dropped."""
    return queries.join(objects.select("name", "idx"), "name").select("qid", "idx", "sign")


def distances(objects: DataFrame, queries: DataFrame, features: Sequence[Feature], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (qid, sign, q, idx, d0, d1, ...): each query object ``q`` of each query against each object; ``keep`` names further columns of the objects."""
    columns = list(dict.fromkeys(name for name, _ in features))
    asked = objects.select("idx", *columns).join(_few(queries), "idx")
    asked = asked.select("qid", "sign", F.col("idx").alias("q"), *[F.col(c).alias(f"q_{c}") for c in columns])
    pairs = objects.select("idx", *dict.fromkeys([*keep, *columns])).crossJoin(_few(asked))
    return pairs.select("qid", "sign", "q", "idx", *keep, *[f(F.col(c), F.col(f"q_{c}")).alias(f"d{j}") for j, (c, f) in enumerate(features)])


def distance_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def normalize(dist: DataFrame, keys: Sequence[str] = ("qid", "q")) -> DataFrame:
    """Divide every distance by its mean over all objects of the same query object; columns of mean 0 stay."""
    names = distance_columns(dist)
    means = dist.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    joined = dist.join(F.broadcast(means), list(keys))  # one row for each query object
    return joined.select(*[F.coalesce(F.col(c) / F.nullif(F.col(f"m_{c}"), F.lit(0.0)), F.col(c)).alias(c) if c in names else F.col(c) for c in dist.columns])


def interact(dist: DataFrame, spec: str) -> DataFrame:
    """``ACTION=min(0,1):ACTION=max(2,3):ACTION=mul(1,2)``: all named columns become their least, largest or product, in order."""
    for part in filter(None, spec.split(":")):
        action, _, arguments = part.partition("=")[2].partition("(")
        columns = [f"d{int(x)}" for x in arguments.rstrip(")").split(",")]
        if action == "mul":
            value = F.lit(1.0)
            for c in columns:
                value = value * F.col(c)
        elif action in ("min", "max"):
            value = (F.least if action == "min" else F.greatest)(*columns) if len(columns) > 1 else F.col(columns[0])
        else:
            raise ValueError(f"unknown action {action!r}")
        dist = dist.select(*[value.alias(c) if c in columns else F.col(c) for c in dist.columns])
    return dist


# Scorers: distance columns to one score.


def linear(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """exp(-sum of weighted distances); missing weights are 0, and columns of weight 0 are not computed."""
    terms = [F.lit(float(w)) * c for c, w in zip(columns, weights, strict=False) if w]
    exponent = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        exponent = exponent + t
    return F.exp(-exponent)


def _softmax(features: Sequence[Column], lambdas: Sequence[Sequence[float]], factor: float, offset: float) -> Column:
    """P(class 1) of two classes; lambdas by class, the bias last. Exponents below -700 count as 0."""
    sums = []
    for own in lambdas:
        s = F.lit(float(own[-1]))
        for f, w in zip(features, own, strict=False):
            s = s + F.lit(float(w)) * (F.lit(factor) * f + F.lit(offset))
        sums.append(F.when(s < -700, F.lit(0.0)).otherwise(F.exp(s)))
    return F.coalesce(sums[1] / F.nullif(sums[0] + sums[1], F.lit(0.0)), F.lit(0.0))


def maxent(columns: Sequence[Column], lambdas, factor: float = 1.0, offset: float = 0.0) -> Column:
    return _softmax(list(columns), lambdas, factor, offset)


def maxent_second(columns: Sequence[Column], lambdas, factor: float = 1.0, offset: float = 0.0) -> Column:
    """Products of all pairs, a column with itself included."""
    return _softmax([a * b for i, a in enumerate(columns) for b in columns[i:]], lambdas, factor, offset)


def maxent_first_second(columns: Sequence[Column], lambdas, factor: float = 1.0, offset: float = 0.0) -> Column:
    return _softmax([*columns, *[a * b for i, a in enumerate(columns) for b in columns[i:]]], lambdas, factor, offset)


def svm_score(columns: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    """exp of a linear decision value."""
    value = F.lit(float(bias))
    for c, w in zip(columns, weights, strict=False):
        value = value + F.lit(float(w)) * c
    return F.exp(value)


SCORERS = {"linear": linear, "maxent": maxent, "maxent2nd": maxent_second, "maxent1st2nd": maxent_first_second, "svm": svm_score}


def scored(dist: DataFrame, scorer: Callable[..., Column] = linear, *parameters, **named) -> DataFrame:
    """(qid, sign, q, idx, s)."""
    return dist.select("qid", "sign", "q", "idx", scorer([F.col(c) for c in distance_columns(dist)], *parameters, **named).alias("s"))


# Combiners: scores over query objects to one score for each object.


def _pos() -> Column:
    return F.col("sign") > 0


def _neg() -> Column:
    return F.col("sign") < 0


def _over(condition: Column, value: Column, how=F.sum) -> Column:
    return how(F.when(condition, value))


def score_sum(s: DataFrame, positive: float = 1.0, negative: float = 0.8333) -> DataFrame:
    p = F.coalesce(F.lit(positive) * _over(_pos(), F.col("s")) / F.nullif(F.count_if(_pos()), F.lit(0)), F.lit(0.0))
    n = F.coalesce(F.lit(negative) * _over(_neg(), 1 - F.col("s")) / F.nullif(F.count_if(_neg()), F.lit(0)), F.lit(0.0))
    return s.groupBy("qid", "idx").agg((p + n).alias("score"))


def _ratio(top: Column, below: Column) -> Column:
    return F.coalesce(top, F.lit(0.0)) / F.coalesce(F.nullif(below, F.lit(0.0)), F.lit(1.0))


def nearest_quotient(s: DataFrame) -> DataFrame:
    return s.groupBy("qid", "idx").agg(_ratio(_over(_pos(), F.col("s"), F.max), _over(_neg(), F.col("s"), F.max)).alias("score"))


def sum_quotient(s: DataFrame) -> DataFrame:
    return s.groupBy("qid", "idx").agg(_ratio(_over(_pos(), F.col("s")), _over(_neg(), F.col("s"))).alias("score"))


TINY = 2.220446049250313e-16


def relevance_score(s: DataFrame) -> DataFrame:
    """1 / (1 + ln(best positive) / ln(best negative)); without negatives these count as 1e-200."""
    p = F.greatest(F.coalesce(_over(_pos(), F.col("s"), F.max), F.lit(0.0)), F.lit(TINY))
    n = F.when(F.count_if(_neg()) == 0, F.lit(1e-200)).otherwise(F.greatest(_over(_neg(), F.col("s"), F.max), F.lit(TINY)))
    quotient = F.ln(p) / F.nullif(F.ln(n), F.lit(0.0))
    return s.groupBy("qid", "idx").agg(F.coalesce(F.lit(1.0) / F.nullif(1 + quotient, F.lit(0.0)), F.lit(0.0)).alias("score"))


def distance_sum_quotient(s: DataFrame, mode: str = "NEGDENOM") -> DataFrame:
    """p and n sum 1 / (ln s + .0001) over positives and negatives; 1 / (1 + p / n), or with ALLDENOM p / (n + p)."""
    each = F.lit(1.0) / F.nullif(F.ln(F.greatest(F.col("s"), F.lit(1e-300))) + F.lit(0.0001), F.lit(0.0))
    p, n = F.coalesce(_over(_pos(), each), F.lit(0.0)), F.coalesce(_over(_neg(), each), F.lit(0.0))
    value = F.lit(1.0) / F.nullif(1 + p / F.nullif(n, F.lit(0.0)), F.lit(0.0)) if mode == "NEGDENOM" else p / F.nullif(n + p, F.lit(0.0))
    return s.groupBy("qid", "idx").agg(F.coalesce(value, F.lit(0.0)).alias("score"))


COMBINERS = {"scoresum": score_sum, "nnquot": nearest_quotient, "sumquot": sum_quotient, "relevanceScore": relevance_score, "distsumquot": distance_sum_quotient}


def rocchio_queries(objects: DataFrame, queries: DataFrame, column: str, beta: float | None = None, gamma: float | None = None, compat: bool = False) -> DataFrame:
    """One new query vector for each query: (qid, vector).

    The first positive plus ``beta`` (1/number) times the sum of the positives minus ``gamma`` (1/number) times that of the
    negatives. By default the first positive is not counted again in the sum; ``compat`` counts it twice.
    """
    asked = objects.select("idx", F.posexplode(column).alias("i", "x")).join(_few(queries), "idx")
    first = queries.where("sign > 0").groupBy("qid").agg(F.min("idx").alias("first"))
    many = queries.groupBy("qid").agg(F.count_if(F.col("sign") > 0).alias("p"), F.count_if(F.col("sign") < 0).alias("n"))
    asked = asked.join(_few(first), "qid").join(_few(many), "qid")
    b = F.lit(beta) if beta is not None else F.lit(1.0) / F.col("p")
    g = F.lit(gamma) if gamma is not None else F.coalesce(F.lit(1.0) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    is_first = F.col("idx") == F.col("first")
    weight = F.when(F.col("sign") < 0, -g).when(is_first, F.lit(1.0) + b if compat else F.lit(1.0)).otherwise(b)
    sums = asked.groupBy("qid", "i").agg(F.sum(weight * F.col("x")).alias("x"))
    return sums.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("qid", F.transform("v", lambda e: e["x"]).alias(column))


def weighted_distance_scores(objects: DataFrame, queries: DataFrame, column: str, mode: str = "WDRelevanceScore") -> DataFrame:
    """Unit-weight distance feedback on flat vectors: nearest negative over nearest positive, or sums of them."""
    d = distances(objects, queries, [(column, lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))])
    how = F.min if mode == "WDRelevanceScore" else F.sum
    p, n = _over(_pos(), F.col("d0"), how), _over(_neg(), F.col("d0"), how)
    return d.groupBy("qid", "idx").agg(F.coalesce(n, F.lit(1.0)).alias("n"), p.alias("p")).select("qid", "idx", F.coalesce(F.col("n") / F.nullif("p", F.lit(0.0)), F.lit(1e300)).alias("score"))


def learned_distance_scores(objects: DataFrame, queries: DataFrame, column: str, positive: Sequence[float], negative: Sequence[float] | None = None) -> DataFrame:
    """Nearest negative over nearest positive by squared differences with learned weights, separate ones for the two signs if given."""
    def weighted(w: Sequence[float]) -> Callable[[Column, Column], Column]:
        return lambda a, b: F.aggregate(F.zip_with(F.array(*map(F.lit, w)), F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x)

    d = distances(objects, queries, [(column, weighted(positive)), (column, weighted(negative or positive))])
    p, n = _over(_pos(), F.col("d0"), F.min), _over(_neg(), F.col("d1"), F.min)
    return d.groupBy("qid", "idx").agg((F.coalesce(n, F.lit(1.0)) / F.coalesce(F.nullif(p, F.lit(0.0)), F.lit(1e-12))).alias("score"))


def weighted_query_scores(s: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Sum of scores, positives s and negatives 1 - s, with one weight for each query object."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("q").cast("int")), F.lit(1.0))
    return s.groupBy("qid", "idx").agg(F.sum(w * F.when(F.col("sign") > 0, F.col("s")).otherwise(1 - F.col("s"))).alias("score"))


# Ranking.


def ranked(results: DataFrame, first: int, last: int | None = None, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Rows with ranks first..last (from 1); equal scores rank the larger idx first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("idx"))
    out = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (last or first))
    return out.where(F.col("rank") >= first) if last and first > 1 else out


def top(results: DataFrame, k: int) -> DataFrame:
    return ranked(results, 1, k)


def page(results: DataFrame, step: int, k: int) -> DataFrame:
    """The ``step``-th further page of k results."""
    return ranked(results, step * k + 1, (step + 1) * k)


def expanded(objects: DataFrame, results: DataFrame, features: Sequence[Feature], weights: Sequence[float], extensions: int) -> DataFrame:
    """Second pass: the best ``extensions`` of each query are its only, positive examples; their scores add up."""
    again = top(results, extensions).select("qid", "idx", F.lit(1).alias("sign"))
    s = scored(normalize(distances(objects, again, features)), linear, weights)
    return s.groupBy("qid", "idx").agg(F.sum("s").alias("score"))


def retrieve(objects: DataFrame, queries: DataFrame, features: Sequence[Feature], weights: Sequence[float], combiner: Callable[[DataFrame], DataFrame] = score_sum, interactor: str = "") -> DataFrame:
    """(qid, idx, score) of all objects."""
    dist = normalize(distances(objects, queries, features))
    return combiner(scored(interact(dist, interactor), linear, weights))


# Cascade.

BEYOND = 1.2


def cascade(objects: DataFrame, queries: DataFrame, stages: Sequence[tuple[int, int]], features: Sequence[Feature], weights: Sequence[float]) -> DataFrame:
    """(qid, idx, score) by a filter cascade of (feature, best k) stages.

    In each stage one further distance is computed for the survivors. Objects dropped before get 1.2 times its largest; columns not
    yet computed are one constant for all, 1 after normalisation. All columns are mean-normalised over all objects, scored, and the best k
    survive. The last scores count for all: positives s, negatives 1 - s, summed.

    The first distance of all objects is one narrow pass, written once. Of later stages only the survivors are rows; the
    dropped ones enter means and scores as a count times a constant.
    """
    (first, k), *rest = stages
    key = ["qid", "q"]
    base = written(distances(objects, queries, [features[first]]), "cascade-first")
    per = written(base.groupBy(*key).agg(F.avg("d0").alias("mean"), F.count("*").alias("n")), "cascade-queries")
    base = base.join(_few(per.select(*key, "mean")), key).select("qid", "sign", "q", "idx", F.coalesce(F.col("d0") / F.nullif("mean", F.lit(0.0)), F.col("d0")).alias(f"x{first}")).drop("mean")
    weight = [weights[j] if j < len(weights) else 0.0 for j in range(len(features))]

    def score(seen: set[int]) -> Column:
        return linear([F.col(f"x{j}") if j in seen else F.lit(1.0) for j in range(len(features))], weight)

    def best(rows: DataFrame, seen: set[int], most: int) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("_s"), F.desc("idx"))
        return rows.withColumn("_s", score(seen)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_s", "_r")

    seen, alive, later = {first}, written(best(base.drop("sign"), {first}, k), "cascade-alive"), []
    for j, k in rest:
        column, f = features[j]
        asked = _few(objects.select(F.col("idx").alias("q"), F.col(column).alias("_q")).join(_few(queries.select(F.col("idx").alias("q")).distinct()), "q"))
        met = objects.select("idx", F.col(column).alias("_d")).join(_few(alive), "idx").join(asked, "q")
        met = written(met.withColumn("_new", f(F.col("_d"), F.col("_q"))).drop("_d", "_q", f"x{j}"), "cascade-stage")
        sums = met.groupBy(*key).agg(F.max("_new").alias("_max"), F.sum("_new").alias("_sum"), F.count("*").alias("_m")).join(per.select(*key, "n"), key)
        beyond = F.lit(BEYOND) * F.col("_max")
        mean = F.nullif((F.col("_sum") + (F.col("n") - F.col("_m")) * beyond) / F.col("n"), F.lit(0.0))
        sums = written(sums.select(*key, mean.alias("_mean"), F.coalesce(beyond / mean, beyond).alias("_beyond")), "cascade-means")
        met = met.join(_few(sums.select(*key, "_mean")), key).withColumn(f"x{j}", F.coalesce(F.col("_new") / F.col("_mean"), F.col("_new"))).drop("_new", "_mean")
        later = [(i, values, constant) for i, values, constant in later if i != j] + [(j, met.select(*key, "idx", f"x{j}"), sums.select(*key, "_beyond"))]
        seen.add(j)
        alive = written(best(met, seen, k), "cascade-alive")
    for j, values, constant in later:
        base = base.drop(f"x{j}").join(_few(values), [*key, "idx"], "left").join(_few(constant), key).withColumn(f"x{j}", F.coalesce(f"x{j}", "_beyond")).drop("_beyond")
    s = base.withColumn("s", score(seen))
    value = F.when(F.col("sign") > 0, F.col("s")).otherwise(1 - F.col("s"))
    return s.groupBy("qid", "idx").agg(F.sum(value).alias("score"))


# Federation.


def federated(objects: DataFrame, shard: Column, queries: DataFrame, features: Sequence[Feature], weights: Sequence[float], k: int, per_shard: bool = False) -> DataFrame:
    """Top k over shards. By default distances are normalised over all shards; ``per_shard`` normalises in each, as independent servers do."""
    dist = distances(objects.withColumn("shard", shard), queries, features, keep=["shard"])
    dist = normalize(dist, ("qid", "q", "shard") if per_shard else ("qid", "q"))
    return top(score_sum(scored(dist, linear, weights)), k)


# Distance tables.


def save_distances(dist: DataFrame, path: str) -> None:
    """Write normalised distances; an existing table is not overwritten."""
    dist.write.mode("errorifexists").parquet(path)


def merge_distances(tables: Sequence[DataFrame]) -> DataFrame:
    """Columns of distance tables side by side, renumbered."""
    out, n = None, 0
    for t in tables:
        names = distance_columns(t)
        t = t.select("qid", "q", "idx", *[F.col(c).alias(f"d{n + i}") for i, c in enumerate(names)])
        n += len(names)
        out = t if out is None else out.join(t, ["qid", "q", "idx"])
    return out


def file_distance(dist: DataFrame, weights: Sequence[float]) -> DataFrame:
    """-ln of the linear score of a stored distance row: (qid, q, idx, d0)."""
    names = distance_columns(dist)
    return dist.select("qid", "q", "idx", (-F.ln(F.greatest(linear([F.col(c) for c in names], weights), F.lit(1e-300)))).alias("d0"))


def cached_distances(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Distances (q, idx, d) of the wanted pairs (q, idx): those in ``cache`` and, for the others, what ``compute`` gives; also the new rows, to append."""
    known = wanted.join(cache, ["q", "idx"]).select("q", "idx", "d")
    new = compute(wanted.join(cache, ["q", "idx"], "left_anti")).select("q", "idx", "d")
    return known.unionByName(new), new


def without_rows(objects: DataFrame, names: Sequence[str]) -> DataFrame:
    """Objects without those named, numbered anew in the old order.

    Numbers are a count by partition plus the place within it, so no task sees all rows.
    """
    kept = objects.where(~F.col("name").isin(list(names))).repartitionByRange("idx").sortWithinPartitions("idx").withColumn("_at", F.spark_partition_id())
    kept = kept.withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_at").cast("long"), 33))
    sizes = sorted((r["_at"], r["count"]) for r in kept.groupBy("_at").count().collect())
    starts, total = {}, 0
    for at, n in sizes:
        starts[at], total = total, total + n
    if not starts:
        return objects.limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_at")).cast("long")
    return kept.withColumn("idx", start + F.col("_n")).drop("_at", "_n")
