"""The queries of this package over the tables of a data folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, jaccard_join, licenses
from lodestar.llm.additive_quantization import neighbours
from lodestar.llm.class_lm import lm_scores
from lodestar.llm.decontamination import contained_items
from lodestar.llm.jaccard_join import jaccard_components
from lodestar.llm.language_id import page_languages
from lodestar.llm.packing import pack
from lodestar.llm.quality import quality_scores
from lodestar.llm.secrets import secret_spans
from lodestar.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_secrets": op3_secrets,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_token_counts": op5_token_counts,
        "op6_class_lm": op6_class_lm,
        "op7_language_id": op7_language_id,
        "op8_licenses": op8_licenses,
        "op9_packing": op9_packing,
        "op10_additive_quantization": op10_additive_quantization,
    }


def oracle_sql() -> dict:
    return {"op2_decontamination": decontamination.oracle(), "op4_jaccard_join": jaccard_join.oracle(), "op8_licenses": licenses.oracle()}
