"""Distances by name over whole tables: those that are expressions of two columns, and those that need more than one row.

``distances`` takes (column, specification) pairs, as sessions keep them. Text measures need word statistics of all
documents, smoothed histograms their neighbours, local features and images two-dimensional algebra; each is its own plan
of rows (q, idx, d), joined with the expressions' distances by query object and object.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from lodestar.functions import distances as D
from lodestar.operators import features as X
from lodestar.operators import retrieval as R
from lodestar.operators import sparse as SP
from lodestar.operators.steps import few

Options = dict[str, str]


def _asked(objects: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    return objects.select(F.col("idx").alias("q"), F.col(column).alias("b")).join(few(queries.select(F.col("idx").alias("q")).distinct()), "q")


def _pairs(objects: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    return objects.select("idx", F.col(column).alias("a")).crossJoin(few(_asked(objects, queries, column)))


def _terms(objects: DataFrame, queries: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    asked = SP.terms(_asked(objects, queries, column), "q", F.col("b")).withColumnRenamed("id", "q")
    return SP.terms(objects, "idx", F.col(column)), asked


def _every(objects: DataFrame, queries: DataFrame, found: DataFrame, missing: float) -> DataFrame:
    """(q, idx, d) of all pairs; objects that share no term get ``missing``."""
    every = objects.select("idx").crossJoin(few(queries.select(F.col("idx").alias("q")).distinct()))
    return every.join(found.select("q", F.col("id").alias("idx"), "d"), ["q", "idx"], "left").select("q", "idx", F.coalesce("d", F.lit(missing)).alias("d"))


def _text(measure: Callable[..., DataFrame]):
    def run(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
        numbers = {k.lower(): float(v) for k, v in options.items()}
        return _every(objects, queries, measure(*_terms(objects, queries, column), **numbers), 1.0)

    return run


def _text_feature(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
    tf, asked = _terms(objects, queries, column)
    found = SP.text_distance(tf, asked, objects.select(F.col("idx").alias("id")))
    return _every(objects, queries, found, SP.NOTHING_FOUND)


def _smoothed(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
    """Maps from arrays of positions to shares; ``STEPS=10x5`` tells the positions by dimension, ``SF`` the share given away."""
    long = objects.select(F.col("idx").alias("id"), F.explode(column).alias("bin", "f"))
    asked = _asked(objects, queries, column).select("q", F.explode("b").alias("bin", "f"))
    d = SP.smoothed_divergence(long, asked, [int(x) for x in options["STEPS"].split("x")], float(options.get("SF", 0.5)))
    return d.select("q", F.col("id").alias("idx"), "d")


def _local_hits(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
    local = objects.select("idx", F.explode(column).alias("v"))
    asked = _asked(objects, queries, column).select("q", F.posexplode("b").alias("f", "v"))
    return X.local_hits(local, asked, "v", int(options.get("K", 10)))


def _earth_mover(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
    pairs = _pairs(objects, queries, column)
    if not isinstance(objects.schema[column].dataType.elementType, StructType):  # bare vectors: one weight for all
        weighted = lambda c: F.transform(c, lambda v: F.struct(F.lit(1.0).alias("weight"), v.alias("v")))
        pairs = pairs.withColumns({"a": weighted("a"), "b": weighted("b")})
    return X.earth_mover(pairs, ["q", "idx"])


def _from_file(objects: DataFrame, queries: DataFrame, column: str, options: Options) -> DataFrame:
    stored = objects.sparkSession.read.parquet(options["FILE"])
    weights = [float(x) for x in options["WEIGHTS"].split("x")] if "WEIGHTS" in options else [1.0] * len(R.distance_columns(stored))
    return R.file_distance(stored, weights).select("q", "idx", F.col("d0").alias("d")).dropDuplicates(["q", "idx"])


Table = Callable[[DataFrame, DataFrame, str, Options], DataFrame]

#: Distances that need whole tables, by the names that specifications use (fixed values).
TABLES: dict[str, Table] = {
    "tfidf": _text(SP.tfidf_distance),
    "bm25": _text(SP.bm25_distance),
    "smart2": _text(SP.smart2_distance),
    "textfeature": _text_feature,
    "smoothedjsd": _smoothed,
    "glfd": _local_hits,
    "lfhungarian": lambda o, q, c, p: X.edge_cover(_pairs(o, q, c), ["q", "idx"]),
    "lfsigemd": _earth_mover,
    "idm": lambda o, q, c, p: X.image_distortion(_pairs(o, q, c), ["q", "idx"], *(int(p.get(k, v)) for k, v in (("WR1", 3), ("WR2", 1)))),
    "imagecrosscorrelation": lambda o, q, c, p: X.cross_correlation(_pairs(o, q, c), ["q", "idx"], int(p.get("D", 4))),
    "distfile": _from_file,
}


def resolved(objects: DataFrame, column: str, spec: str) -> str:
    """``spec`` made whole by the column's type: an empty one is the type's default, images and maps have their own forms."""
    kind = objects.schema[column].dataType
    name, _, options = (spec or _default(kind)).partition(":")
    name = name.lower()
    if isinstance(kind, StructType) and name == "crosscorrelation":
        name = "imagecrosscorrelation"
    if isinstance(kind, MapType) and name in ("jsd", "jd"):
        share = float(_options(options).get("SF", 0.5 if isinstance(kind.keyType, ArrayType) else 0.0))
        if share < 0:
            raise ValueError("a smoothing share is not negative")
        name, options = ("smoothedjsd", options) if share else ("sparsejsd", "")
    if isinstance(kind, MapType) and name in ("fidelity", "omf", "oneminusfidelity"):
        name = "sparsefidelity"
    return f"{name}:{options}" if options else name


def _default(kind) -> str:
    if isinstance(kind, MapType):
        return "metafeature" if kind.valueType.simpleString() == "string" else "jsd"
    if isinstance(kind, BooleanType):
        return "binary"
    if isinstance(kind, StructType):
        return "idm"
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        return "lfhungarian"
    return "euclidean" if isinstance(kind, ArrayType) else "textfeature"


def _options(text: str) -> Options:
    return {k.upper(): v for k, _, v in (x.partition("=") for x in text.split(":") if x)}


def check(objects: DataFrame, column: str, spec: str) -> None:
    """Raise for a name that is none."""
    name, _, options = resolved(objects, column, spec).partition(":")
    if name not in TABLES:
        D.distance(f"{name}:{options}" if options else name)


def distances(objects: DataFrame, queries: DataFrame, features: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (qid, sign, q, idx, d0, d1, ...) for (column, specification) features, in their order."""
    plain, tables = [], []
    for i, (column, spec) in enumerate(features):
        name, _, options = resolved(objects, column, spec).partition(":")
        if name in TABLES:
            tables.append((i, TABLES[name](objects, queries, column, _options(options))))
        else:
            plain.append((i, (column, D.distance(f"{name}:{options}" if options else name))))
    out = R.distances(objects, queries, [f for _, f in plain])
    out = out.select("qid", "sign", "q", "idx", *[F.col(f"d{j}").alias(f"_{i}") for j, (i, _) in enumerate(plain)])
    for i, d in tables:
        out = out.join(d.select("q", "idx", F.col("d").alias(f"_{i}")), ["q", "idx"])
    return out.select("qid", "sign", "q", "idx", *[F.col(f"_{i}").alias(f"d{i}") for i in range(len(features))])
