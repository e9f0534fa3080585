"""Benchmark decontamination: size-partitioned MinHash containment, verified by exact shingle containment.

Items are short and documents long, so their Jaccard similarity says nothing and containment is asked
for: which share of an item's distinct word shingles lies in the document. Items are partitioned by size. An item
of n shingles keeps its k smallest hashes, k = n - ceil(threshold n) + 1 for the largest n of its
partition, so that a document which contains the threshold share of the shingles must have one of them. A document's
sketch keeps its hashes up to the largest hash of any item's sketch. Documents and items that share a
sketch hash are candidates; their whole shingle sets are then compared. All of it is DataFrame functions.

Words are runs of letters and digits, lower-cased. Items of fewer than ``width`` words are shingles of
their own length: the document has to contain the whole item.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, small

#: Sketch rows, and item rows, up to which the benchmark is broadcast (some 30 MB); beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Upper bounds of the size partitions of items, in shingles; beyond the last, powers of two.
SIZES = (4, 8, 16, 32, 64, 128, 256)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, widths: list[int]) -> Column:
    """The hashes of all runs of each width in an array of word hashes."""
    def runs(w: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(hashes) - F.lit(w)), lambda i: F.xxhash64(F.lit(w), *(F.get(hashes, i + F.lit(k)) for k in range(w))))
        return F.when(F.size(hashes) >= w, at).otherwise(F.array().cast("array<long>"))

    parts = [runs(w) for w in widths]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_found, containment) of the items that documents contain.

    ``n_item`` counts an item's distinct shingles. Null ids on either side take no part, nor do items
    without words; null and empty documents contain nothing. Rows that share a doc_id count as one document by the best of
    them; rows that share an item_id likewise. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    item_words = items.select(F.col(item_col).cast("long").alias("item_id"), hashed(F.col(item_text_col).cast("string")).alias("words")).where("item_id is not null and size(words) > 0")
    per_width = [item_words.where(F.least(F.size("words"), F.lit(width)) == w).select("item_id", F.array_distinct(shingle_hashes(F.col("words"), [w])).alias("item")) for w in range(1, width + 1)]
    known = per_width[0]
    for more in per_width[1:]:
        known = known.union(more)
    upper = F.lit(None).cast("long")
    for most in reversed(SIZES):
        upper = F.when(F.size("item") <= most, most).otherwise(upper)
    upper = F.coalesce(upper, F.pow(F.lit(2.0), F.ceil(F.log2(F.size("item").cast("double")))).cast("long"))
    # The largest sketch that any item of the partition needs, at most the whole item.
    known = known.select("item_id", "item", F.size("item").alias("n_item"), upper.alias("upper"))
    known = known.withColumn("sketch", F.slice(F.array_sort("item"), F.lit(1), F.least(F.col("n_item"), (F.col("upper") - F.ceil(F.lit(threshold) * F.col("upper") - 1e-9) + 1).cast("int"))))
    known = durable(known, "decontamination-items")
    sketches = known.select(F.explode("sketch").alias("h"), "item_id", "n_item").distinct()
    largest = sketches.agg(F.max("h")).head()[0]
    used = sorted({x["w"] for x in item_words.select(F.least(F.size("words"), F.lit(width)).alias("w")).distinct().collect()}) or [width]

    hashed_docs = rows.select("doc_id", hashed(F.col("text")).alias("words"))
    sketch = hashed_docs.select("doc_id", F.explode(F.filter(shingle_hashes(F.col("words"), used), lambda h: h <= F.lit(largest))).alias("h"))
    candidates = durable(sketch.join(small(sketches, BROADCAST_ROWS), "h").select("doc_id", "item_id").distinct(), "decontamination-candidates")

    named = candidates.select("doc_id").distinct()
    texts = rows.join(named, "doc_id", "left_semi").select("doc_id", hashed(F.col("text")).alias("words")).select("doc_id", F.array_distinct(shingle_hashes(F.col("words"), used)).alias("have"))
    pairs = texts.join(candidates, "doc_id").join(small(known.select("item_id", "item", "n_item"), BROADCAST_ROWS // 16), "item_id")
    found = pairs.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("item", "have")).cast("long").alias("n_found"))
    found = found.withColumn("containment", F.col("n_found") / F.col("n_item")).where(F.col("containment") >= threshold - 1e-9)
    best = F.max(F.struct("containment", "n_found", "n_item")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_found", "best.containment")


def oracle(docs: str = "documents", items: str = "benchmark", width: int = 5, threshold: float = 0.8) -> str:
    """The same in DuckDB's SQL, by the join of all shingles."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    grams = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))"
    return f"""WITH i AS (SELECT item_id, w, least(len(w), {width}) AS k FROM (SELECT item_id, {words} AS w FROM {items}) WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, unnest({grams}) AS g FROM i), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
d AS (SELECT DISTINCT doc_id, k, unnest({grams}) AS g FROM (SELECT doc_id, {words} AS w FROM {docs}), (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
f AS (SELECT doc_id, q.item_id, count(*) AS found FROM d JOIN q ON d.k = q.k AND d.g = q.g GROUP BY 1, 2)
SELECT doc_id, f.item_id AS item_id, n AS n_item, found AS n_found, found / n AS containment FROM f JOIN n ON n.item_id = f.item_id WHERE found / n >= {threshold} - 1e-9"""
