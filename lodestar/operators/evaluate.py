"""Ground truth and retrieval-quality metrics.

``ranking`` has (q, idx, rank) with ranks from 0, the query itself normally at 0; ``truth`` has (q, idx), the relevant objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.steps import few, written

#: Arrays of members and members (8 bytes each) up to which they are broadcast; more are joined by a shuffle. Members of an array, about.
ARRAYS, MEMBERS, LENGTH = 1_000_000, 4_000_000, 4_096


def truth_by_class(objects: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(q, idx): objects of the query's class, itself excluded."""
    asked = (objects if queries is None else queries).select(F.col("idx").alias("q"), "class")
    return asked.join(objects.select("idx", "class"), "class").where("q <> idx").select("q", "idx")


def overlap_classes(objects: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(idx, class), objects by their set of words, and (a, b), the classes that share a word, each with itself: written tables."""
    words = F.array_sort(F.array_distinct(column))
    members = written(objects.select("idx", words.alias("w")).where(F.size("w") > 0).select("idx", "w", F.xxhash64("w").alias("class")).distinct(), "overlap-members")
    sets = members.select("class", "w").distinct()
    # A hash that two sets share would join them: the sets are then told apart by themselves.
    if sets.groupBy("class").count().where("count > 1").limit(1).count():
        names = written(sets.select("w", F.monotonically_increasing_id().alias("class")), "overlap-names")
        members, sets = written(members.drop("class").join(names, "w"), "overlap-members"), names
    each = written(sets.select("class", F.explode("w").alias("w")), "overlap-words")
    pairs = each.select(F.col("class").alias("a"), "w").join(each.select(F.col("class").alias("b"), "w"), "w").select("a", "b").distinct()
    return members.select("idx", "class"), written(pairs, "overlap-classes")


def truth_by_overlap(objects: DataFrame, column: str) -> DataFrame:
    """(q, idx): objects that share a word of an array column, itself excluded.

    Pairs are found between classes of equal word sets. A class is a few arrays of members, which are broadcast and exploded
    beside each object, so no pair of objects is shuffled, spilled or made twice. Objects that repeat an id have all their words.
    """
    if objects.groupBy("idx").count().where("count > 1").limit(1).count():
        objects = objects.groupBy("idx").agg(F.flatten(F.collect_list(column)).alias(column))
    members, pairs = overlap_classes(objects, column)
    number = members.groupBy(F.col("class").alias("b")).agg(F.ceil(F.count("*") / LENGTH).alias("arrays"))
    dealt = members.select(F.col("class").alias("b"), F.col("idx").alias("one")).join(number, "b").withColumn("at", F.pmod(F.xxhash64("one"), F.col("arrays")))
    arrays = written(dealt.groupBy("b", "at").agg(F.collect_list("one").alias("ids")).select("b", "ids"), "overlap-arrays")
    left = members.toDF("q", "a").repartition(4 * members.sparkSession.sparkContext.defaultParallelism, "q")
    right = few(arrays, ARRAYS if members.count() <= MEMBERS else 0)
    return left.join(few(pairs), "a").select("q", "b").join(right, "b").select("q", F.explode("ids").alias("idx")).where("q <> idx")


def hits(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, idx, rank, rel, i): results without the query, whether relevant, and the relevant ones so far."""
    r = ranking.where("idx <> q").join(truth.withColumn("rel", F.lit(1)), ["q", "idx"], "left").fillna({"rel": 0})
    so_far = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("i", F.sum("rel").over(so_far))


def summary(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each query: er, ap, amp, are, rank1, rank_tilde, relevant."""
    number = truth.groupBy("q").agg(F.count("*").alias("relevant"))
    sizes = ranking.groupBy("q").agg(F.count("*").alias("n"))
    h = hits(ranking, truth).join(number, "q").join(sizes, "q")
    rel, rank, i, n, r = F.col("rel") == 1, F.col("rank"), F.col("i"), F.col("n"), F.col("relevant")
    out = h.groupBy("q").agg(
        F.min_by(F.lit(1) - F.col("rel"), "rank").cast("double").alias("er"),
        F.coalesce(F.sum(F.when(rel, F.lit(100.0) * i / rank)) / F.first(r), F.lit(0.0)).alias("ap"),
        F.coalesce(F.sum(F.when(rel, F.lit(100.0) * (n - rank) / F.nullif(n - i, F.lit(0)))) / F.first(r), F.lit(0.0)).alias("amp"),
        F.coalesce(F.sum(F.when(rel, rank)) / F.nullif(F.sum(F.when(rel, i)), F.lit(0)), F.lit(0.0)).alias("are"),
        F.min(F.when(rel, rank)).alias("rank1"),
        ((F.coalesce(F.sum(F.when(rel, rank)), F.lit(0)) - F.first(r) * (F.first(r) - 1) / 2) / (F.first(n) * F.first(r))).alias("rank_tilde"),
        F.first(r).alias("relevant"),
    )
    return out


def precision_recall(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, rank, precision, recall, interpolated): interpolated is the best precision at this recall or beyond."""
    number = truth.groupBy("q").agg(F.count("*").alias("relevant"))
    h = hits(ranking, truth).join(number, "q")
    at = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    h = h.withColumn("precision", F.col("i") / at).withColumn("recall", F.col("i") / F.col("relevant"))
    back = Window.partitionBy("q").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select("q", "rank", "precision", "recall", F.max("precision").over(back).alias("interpolated"))


def eleven_points(curve: DataFrame) -> DataFrame:
    """(q, level, precision): interpolated precision at recalls 0, .1, ..., 1."""
    levels = curve.sparkSession.range(11).select((F.col("id") / 10).alias("level"))
    met = curve.select("q").distinct().crossJoin(F.broadcast(levels)).join(curve.select("q", "recall", "interpolated"), "q")
    best = F.max(F.when(F.col("recall") >= F.col("level") - 1e-12, F.col("interpolated")))
    return met.groupBy("q", "level").agg(F.coalesce(best, F.lit(0.0)).alias("precision"))


def area(points: DataFrame) -> DataFrame:
    """(q, area) under the eleven points by the trapezoid rule."""
    half = F.when(F.col("level").isin(0.0, 1.0), F.lit(0.5)).otherwise(F.lit(1.0))
    return points.groupBy("q").agg(F.sum(half * F.col("precision") * F.lit(0.1)).alias("area"))


def precision_at(ranking: DataFrame, truth: DataFrame, k: int, compat: bool = False) -> DataFrame:
    """(q, p): precision among the first k results; ``compat`` reads the curve one rank further."""
    reach = k + 1 if compat else k
    return hits(ranking, truth).where(F.col("rank") <= reach).groupBy("q").agg((F.sum("rel") / F.lit(reach)).alias("p"))


def recall_at(ranking: DataFrame, truth: DataFrame, k: int = 100) -> DataFrame:
    number = truth.groupBy("q").agg(F.count("*").alias("relevant"))
    return hits(ranking, truth).where(F.col("rank") <= k).groupBy("q").agg(F.sum("rel").alias("found")).join(number, "q").select("q", (F.col("found") / F.col("relevant")).alias("recall"))


def precision_at_recall(curve: DataFrame, half: Column | float = 0.5) -> DataFrame:
    """(q, r_at_half, break_even): the largest recall with precision of at least ``half``, and precision where it meets recall."""
    return curve.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("precision") >= half, F.col("recall"))), F.lit(0.0)).alias("r_at_half"), F.coalesce(F.max(F.least("precision", "recall")), F.lit(0.0)).alias("break_even"))


def confusion(predicted: DataFrame) -> DataFrame:
    """(truth, prediction, n)."""
    return predicted.groupBy("truth", "prediction").agg(F.count("*").alias("n"))


def nearest_class(ranking: DataFrame, objects: DataFrame, leave_one_out: bool = True) -> DataFrame:
    """(q, truth, prediction): class of the first result, the query itself left out."""
    first = ranking.where("idx <> q" if leave_one_out else "true").groupBy("q").agg(F.min_by("idx", "rank").alias("idx"))
    guessed = first.join(objects.select("idx", F.col("class").alias("prediction")), "idx")
    return guessed.join(objects.select(F.col("idx").alias("q"), F.col("class").alias("truth")), "q").select("q", "truth", "prediction")


def precision_at_relevant(ranking: DataFrame, truth: DataFrame, compat: bool = False) -> DataFrame:
    """(q, p): precision among as many first results as are relevant; ``compat`` reads the curve one rank further."""
    number = truth.groupBy("q").agg(F.count("*").alias("relevant"))
    reach = F.col("relevant") + F.lit(int(compat))
    return hits(ranking, truth).join(number, "q").where(F.col("rank") <= reach).groupBy("q").agg((F.sum("rel") / F.first(reach)).alias("p"))


def averages(ranking: DataFrame, truth: DataFrame, compat: bool = False) -> DataFrame:
    """One row: the means over all queries with relevant objects of every metric, and the number of queries."""
    curve = precision_recall(ranking, truth)
    one = summary(ranking, truth)
    for name, more in (
        *((f"p{k}", precision_at(ranking, truth, k, compat).withColumnRenamed("p", f"p{k}")) for k in (1, 20, 50)),
        ("pnrel", precision_at_relevant(ranking, truth, compat).withColumnRenamed("p", "pnrel")),
        ("r100", recall_at(ranking, truth, 100 + int(compat)).withColumnRenamed("recall", "r100")),
        ("prarea", area(eleven_points(curve)).withColumnRenamed("area", "prarea")),
    ):
        one = one.join(more.select("q", name), "q")
    one = one.join(precision_at_recall(curve), "q")
    names = ["er", "ap", "amp", "are", "rank1", "rank_tilde", "p1", "p20", "p50", "pnrel", "r100", "prarea", "r_at_half", "break_even"]
    return one.agg(*[F.avg(c).alias({"ap": "map"}.get(c, c)) for c in names], F.count("*").alias("queries"))


def example_ranking(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, idx, rank) from (qid, idx, score) of queries with several examples, the examples themselves left out.

    ``q`` is -1 - qid, so that no query is mistaken for the object of the same number; ranks begin at 1.
    """
    left = results.join(queries.select("qid", "idx").distinct(), ["qid", "idx"], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("idx"))
    return left.select((-1 - F.col("qid")).cast("long").alias("q"), "idx", F.row_number().over(order).alias("rank"))
