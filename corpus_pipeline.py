"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, durable, small
from lodestar.llm.decontamination import contained_items
from lodestar.llm.jaccard_join import jaccard_components
from lodestar.llm.packing import pack
from lodestar.llm.quality import keep_good
from lodestar.llm.registry import table, tokenizer
from lodestar.llm.secrets import redact_secrets

#: Ids of dropped documents up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Near duplicates share so many percent of their shingles of so many words; op4_jaccard_join has a rule of its own.
WIDTH, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows without words are rejected; null ids and repeated rows are decided alike by their text; an empty table stays empty."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id. Rows with a null id stay."""
    found = durable(jaccard_components(docs, width=WIDTH, percent=PERCENT), "pipeline-components")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Rows that share an id: one stays, the least by its text, one without text only if there is no other.
        first = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("row"))
        docs = first.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(small(dropped, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows with a null id, a null or an empty text stay; all rows of an id go with the first that contains one."""
    leaks = durable(contained_items(docs, table(spark, sf_dir, "benchmark")), "pipeline-leaks").select("doc_id").distinct()
    return docs.join(small(leaks, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark. Null and empty texts stay as they are, and all rows and columns."""
    redacted = redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is its end id alone; repeated rows are packed as often as they occur."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifier, the secrets' novelty or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are a table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
