"""Sparse histograms and text ranking by an inverted index.

A sparse histogram in long form is rows (id, bin, n); text is rows (id, term, tf). Query and stored
documents meet by an equi-join on the term, never pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.steps import few, written


def terms(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf): lower-cased runs of letters and digits, counted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def feed(points: DataFrame, keys: Sequence[str], bin_col: Column) -> DataFrame:
    """(keys, bin, n): histogram counts."""
    return points.groupBy(*keys, bin_col.alias("bin")).agg(F.count("*").alias("n"))


def relative(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With ``f``, the share of each bin; totals are an aggregate joined back, not a window."""
    totals = histogram.groupBy(*keys).agg(F.sum("n").alias("total"))
    return histogram.join(totals, list(keys)).withColumn("f", F.col("n") / F.nullif("total", F.lit(0)))


def pruned(histogram: DataFrame, keys: Sequence[str], least: int = 0, least_share: float = 0.0) -> DataFrame:
    """Without bins of fewer than ``least`` counts or less than ``least_share``; shares are of what is left."""
    kept = relative(histogram, keys).where((F.col("n") >= least) & (F.col("f") >= least_share)).drop("total", "f")
    return relative(kept, keys)


def merged_by_prefix(histogram: DataFrame, prefix: Column) -> DataFrame:
    """Histograms of ids with a common prefix added up."""
    return histogram.groupBy(prefix.alias("prefix"), "bin").agg(F.sum("n").alias("n"))


def dense(histogram: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, data): counts of bins 0..bins-1 as one array."""
    m = histogram.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("data"))


def smoothed(histogram: DataFrame, keys: Sequence[str], steps: Sequence[int], share: float, compat: bool = False) -> DataFrame:
    """Bins (arrays of positions in ``bin``) keep 1 - share of ``f`` and give the rest to their neighbours by one step in one dimension.

    The share is split evenly over the neighbours that exist, so mass is conserved; ``compat`` splits it by the number of dimensions.
    """
    size = len(steps)
    neighbours = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.transform(F.array(F.lit(-1), F.lit(1)), lambda o: F.transform("bin", lambda p, i: F.when(i == d, p + o).otherwise(p)))))
    limits = F.array(*map(F.lit, steps))
    inside = F.filter(neighbours, lambda b: F.forall(F.zip_with(b, limits, lambda p, s: (p >= 0) & (p < s)), lambda ok: ok))
    number = F.lit(size) if compat else F.nullif(F.size("near"), F.lit(0))
    rows = histogram.select(*keys, "bin", "f", inside.alias("near"))
    own = rows.select(*keys, "bin", (F.col("f") * F.when(F.size("near") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - share))).alias("f"))
    given = rows.select(*keys, F.explode("near").alias("bin"), (F.col("f") * F.lit(share) / number).alias("f"))
    return own.unionByName(given).groupBy(*keys, "bin").agg(F.sum("f").alias("f"))


def pair_sums(stored: DataFrame, asked: DataFrame, value: Column) -> DataFrame:
    """(q, id, v): sums of ``value`` over the terms that stored (id, term, f) and asked (q, term, g) share."""
    return stored.join(asked, "term").groupBy("q", "id").agg(F.sum(value).alias("v"))


def sparse_distances(stored: DataFrame, asked: DataFrame, measure: str = "fidelity") -> DataFrame:
    """(q, id, d) of every query against every stored histogram by the inverted index.

    Both have shares by ``term``. Bins that only one side has add a constant for each object, so the shared terms suffice:
    fidelity needs only them, and the Jensen-Shannon divergence of shares is 2 ln 2 plus a correction on them.
    """
    objects, queries = stored.select("id").distinct(), asked.select("q").distinct()
    if measure == "fidelity":
        v = F.sqrt(F.col("f") * F.col("g"))
        start, sign = F.lit(1.0), F.lit(-1.0)
    else:
        f, g, two = F.col("f"), F.col("g"), F.lit(2.0)
        v = f * F.ln(two * f / (f + g)) + g * F.ln(two * g / (f + g)) - (f + g) * F.ln(two)
        start, sign = None, F.lit(1.0)
    found = pair_sums(stored, asked, v)
    every = objects.crossJoin(few(queries)).join(found, ["q", "id"], "left")
    if start is None:
        every = every.join(stored.groupBy("id").agg(F.sum("f").alias("sf")), "id").join(asked.groupBy("q").agg(F.sum("g").alias("sg")), "q")
        start = (F.col("sf") + F.col("sg")) * F.ln(F.lit(2.0))
    return every.select("q", "id", (start + sign * F.coalesce("v", F.lit(0.0))).alias("d"))


def smoothed_divergence(histogram: DataFrame, asked: DataFrame, steps: Sequence[int], share: float = 0.5, compat: bool = False) -> DataFrame:
    """(q, id, d): Jensen-Shannon divergences of (id, bin, f) against (q, bin, f), both smoothed by ``share`` first; 0 leaves them as they are."""
    if share < 0:
        raise ValueError("a smoothing share is not negative")

    def shares(h: DataFrame, key: str) -> DataFrame:
        h = smoothed(h, [key], steps, share, compat) if share else h
        return h.select(key, F.concat_ws(":", F.transform("bin", lambda x: x.cast("string"))).alias("term"), "f")

    return sparse_distances(written(shares(histogram, "id"), "smoothed"), shares(asked, "q").withColumnRenamed("f", "g"), "jsd")


def difference(a: Column, b: Column) -> Column:
    """Maps: |x - y| by bin, or whichever there is."""
    return F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))


# Text ranking.


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, idf): idf = ln(N / df) squared."""
    n = tf.select("id").distinct().agg(F.count("*").alias("N"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).withColumn("idf", F.pow(F.ln(F.col("N") / F.col("df")), F.lit(2.0))).select("term", "df", "idf")


def tfidf_distance(tf: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, d) = 1 - sum over shared terms of sqrt(relative tf of the query x of the document)."""
    shares = relative(tf.withColumnRenamed("tf", "n"), ["id"]).select("id", "term", "f")
    query = relative(asked.withColumnRenamed("tf", "n"), ["q"]).select("q", "term", F.col("f").alias("g"))
    return pair_sums(shares, query, F.sqrt(F.col("f") * F.col("g"))).select("q", "id", (1 - F.col("v")).alias("d"))


def bm25_distance(tf: DataFrame, asked: DataFrame, k1: float = 1.5, k3: float = 8.0, b: float = 0.68) -> DataFrame:
    """(q, id, d): 1 - normalised BM25 with idf ln(N/df) squared and cosine length norms, over documents that share a term.

    The term counts are written once and read by every statistic; of document frequencies only those of the query's terms are kept.
    """
    tf, asked = written(tf, "term-counts"), written(asked, "asked-terms")
    lengths = tf.groupBy("id").agg(F.sum("tf").alias("len"), F.sqrt(F.sum(F.col("tf") * F.col("tf").cast("double"))).alias("dn"))
    avg = F.broadcast(lengths.agg(F.avg("len").alias("avgdl")))
    norms = asked.groupBy("q").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf").cast("double"))).alias("qn"))
    n = F.broadcast(lengths.agg(F.count("*").alias("N")))
    frequency = tf.join(few(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = frequency.crossJoin(n).select("term", F.pow(F.ln(F.col("N") / F.col("df")), F.lit(2.0)).alias("idf"))
    query = written(asked.select("q", "term", F.col("tf").alias("qtf")).join(idf, "term"), "query-terms")
    joined = tf.join(few(query), "term").join(lengths, "id").crossJoin(avg)
    big_k = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avgdl"))
    v = F.col("idf") * F.lit(k1 + 1) * F.col("tf") / (big_k + F.col("tf")) * F.lit(k3 + 1) * F.col("qtf") / (F.lit(k3) + F.col("qtf"))
    return joined.groupBy("q", "id").agg(F.sum(v).alias("v"), F.first("dn").alias("dn")).join(few(norms), "q").select("q", "id", (1 - F.col("v") / (F.col("qn") * F.col("dn"))).alias("d"))


def smart2_distance(tf: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, d): 1 - ratio of document to query weights over shared terms, with pivoted length by single terms."""
    stats = tf.groupBy("id").agg(F.avg("tf").alias("mean_tf"), F.count_if(F.col("tf") == 1).alias("singles"))
    pivot = F.broadcast(stats.agg(F.avg("singles").alias("pivot")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    query = asked.select("q", "term", F.col("tf").alias("qtf")).join(df, "term").withColumn("wq", (1 + F.ln("qtf")) * F.col("df"))
    joined = tf.join(query, "term").join(stats, "id").crossJoin(pivot)
    wd = ((1 + (1 + F.ln("tf"))) / (1 + F.col("mean_tf"))) / F.nullif(F.lit(0.8) * F.col("pivot") + F.lit(0.3) * F.col("singles"), F.lit(0.0))
    return joined.groupBy("q", "id").agg(F.sum(wd).alias("n"), F.sum("wq").alias("m")).select("q", "id", (1 - F.coalesce(F.col("n") / F.nullif("m", F.lit(0.0)), F.lit(0.0))).alias("d"))


#: The distance of all documents where none is found.
NOTHING_FOUND = 10_000.0


def text_distance(tf: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(q, id, d) of every document: the query's largest similarity minus the document's, 1 - d of BM25.

    Documents that share no term are as far as that largest similarity; queries that find nothing are 10,000 from all.
    """
    found = written(bm25_distance(tf, asked).select("q", "id", (1 - F.col("d")).alias("rsv")), "text-hits")
    top = asked.select("q").distinct().join(found.groupBy("q").agg(F.max("rsv").alias("top")), "q", "left")
    every = documents.select("id").distinct().crossJoin(few(top)).join(found, ["q", "id"], "left")
    return every.select("q", "id", F.coalesce(F.col("top") - F.coalesce("rsv", F.lit(0.0)), F.lit(NOTHING_FOUND)).alias("d"))


LANGUAGE_PART = re.compile(r'([A-Za-z]{2,3}):"([^"]*)"')


def language_parts(query: str) -> list[tuple[str, str]]:
    """(language, text) of ``En:"..." Fr:"..."``; an empty list for a query without languages. Other text beside the parts is an error."""
    parts = LANGUAGE_PART.findall(query)
    if re.search(r'\b[A-Za-z]{2,3}:"', query) and LANGUAGE_PART.sub("", query).strip():
        raise ValueError(f"malformed query {query!r}")
    return [(lang.lower(), text) for lang, text in parts]


def text_scores(tf: DataFrame, asked: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(q, id, score) of documents that share a term with the query text: exp(-d / mean d), summed over query languages.

    With ``languages`` (id, lang) a query part (q, lang, term, tf) meets the documents of its language only.
    """
    if languages is None:
        d = bm25_distance(tf, asked)
        return _hit_scores(d).select("q", "id", "score")
    parts = asked.withColumn("q", F.struct("q", "lang")).select("q", "term", "tf")
    d = bm25_distance(tf, parts).join(languages, "id").where(F.col("lang") == F.col("q.lang")).drop("lang")
    return _hit_scores(d).groupBy(F.col("q.q").alias("q"), "id").agg(F.sum("score").alias("score"))


def _hit_scores(d: DataFrame) -> DataFrame:
    means = F.broadcast(d.groupBy("q").agg(F.avg("d").alias("m")))
    return d.join(means, "q").withColumn("score", F.exp(-F.coalesce(F.col("d") / F.nullif("m", F.lit(0.0)), F.col("d"))))


def meta_scores(objects: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """(idx, score) of objects whose number of missing or different keys, divided by its mean, is below the number of terms."""
    if not wanted:
        return objects.select("idx", F.lit(0.0).alias("score")).limit(0)
    misses = F.lit(0.0)
    for k, v in wanted.items():
        misses = misses + F.when(F.element_at(F.col(column), F.lit(k)).eqNullSafe(F.lit(v)), F.lit(0.0)).otherwise(F.lit(1.0))
    d = objects.select("idx", misses.alias("d"))
    mean = F.broadcast(d.agg(F.avg("d").alias("m")))
    n = F.coalesce(F.col("d") / F.nullif("m", F.lit(0.0)), F.col("d"))
    return d.crossJoin(mean).where(n < len(wanted)).select("idx", F.exp(-n).alias("score"))


def meta_keys(objects: DataFrame, column: str) -> DataFrame:
    """(key, n, example): each key, how often it occurs, and its value in the first object that has it."""
    e = objects.select("idx", F.explode(column).alias("key", "value"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.min_by("value", "idx").alias("example"))
