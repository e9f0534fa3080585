"""The retrieval data model over the test tables: objects with typed feature columns, queries and ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.arrays import scaled_to_unit

#: (qid, example, sign)
QUERIES = [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, -1), (2, 3, 1), (2, 4, 1), (2, 5, -1), (2, 6, -1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, name, class, v (vector), h (histogram: squares of a unit vector), flag, lf (8 local vectors), image (8 x 8 x 1)."""
    v = F.col("v")
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("v"))
    return df.select(
        "idx", F.concat(F.lit("o"), F.col("idx").cast("string")).alias("name"), "class", "v", F.transform(v, lambda x: x * x).alias("h"), (v[0] > 0).alias("flag"),
        F.array(*[F.slice(v, 1 + 8 * i, 8) for i in range(8)]).alias("lf"),
        F.struct(F.lit(8).alias("x"), F.lit(8).alias("y"), F.lit(1).alias("z"), scaled_to_unit(v).alias("data")).alias("image"),
    )


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "qid int, idx long, sign int")


def local_rows(objs: DataFrame) -> DataFrame:
    """(idx, x, y, v): one row for each local vector."""
    return objs.select("idx", F.posexplode("lf").alias("x", "v")).withColumn("y", F.lit(0))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx and meta: brand, type and size of parts as a map."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("idx"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("meta"))


def centres(objs: DataFrame, k: int, column: str = "v") -> np.ndarray:
    """The vectors of the first ``k`` objects, as fixed centres."""
    return np.array([r[0] for r in objs.where(F.col("idx") < k).orderBy("idx").select(column).collect()])


def r6(x: Column) -> Column:
    """Rounded for comparison; -0.0 becomes 0.0."""
    return F.round(x, 6) + F.lit(0.0)


# The same in SQL.

OBJ = """obj AS (SELECT vec_id AS idx, label AS class, CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*x) AS h FROM embeddings)"""
QS = "qs AS (SELECT qid, CAST(q AS BIGINT) AS q, sign FROM (VALUES " + ", ".join(map(str, QUERIES)) + ") AS t(qid, q, sign))"


def zs(expr: str, a: str, b: str) -> str:
    """Sum over zipped arrays of an expression in t[1] and t[2]."""
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda t: CAST({expr} AS DOUBLE))), 0.0)"


def s6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


EU = "(t[1]-t[2])*(t[1]-t[2])"
JSD = "(CASE WHEN t[1]>0 THEN t[1]*ln(2*t[1]/nullif(t[1]+t[2],0)) ELSE 0 END)+(CASE WHEN t[2]>0 THEN t[2]*ln(2*t[2]/nullif(t[1]+t[2],0)) ELSE 0 END)"
FID = "sqrt(t[1])*sqrt(t[2])"
