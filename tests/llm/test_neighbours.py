"""Neighbour search against brute force: recall where candidates are cut, exact mode, equal vectors, few visible rows."""

import numpy as np
import pandas as pd
import pytest

from lodestar.llm import additive_quantization as A


def table(spark, tmp_path, x):
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x.astype("float32"))}).to_parquet(tmp_path / "e.parquet", row_group_size=4_000)
    return spark.read.parquet(str(tmp_path / "e.parquet"))


def brute(x, queries, k=20):
    x = x.astype("float32").astype(float)
    out = {}
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


def test_recall_on_many_vectors_with_a_hot_group(spark, tmp_path):
    """50,000 vectors, a hundred times as many as are scored exactly; a third near one vector."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 64))
    x[:16_000] = x[0] + 0.5 * rng.normal(size=(16_000, 64))
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = A.neighbours(table(spark, tmp_path, x), every=500).toPandas()
    want = brute(x, range(0, 50_000, 500))
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 100
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert np.mean([len(found[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_exact_mode_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3_000, 32))
    x[100:130] = x[100]  # ties
    got = A.neighbours(table(spark, tmp_path, x), lists=256, rerank=3_000).toPandas().sort_values(["query_id", "rank"])
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id")} == brute(x, range(0, 3_000, 20))


@pytest.mark.parametrize("lists", [1, 3])
def test_queries_with_few_rows_in_their_lists_visit_all(spark, tmp_path, lists, monkeypatch):
    monkeypatch.setattr(A, "PART", 50)
    monkeypatch.setattr(A, "CELL", 120)
    monkeypatch.setattr(A, "QUERIES", 7)
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(400, 8)), np.tile(rng.normal(size=8), (300, 1))])  # one list of 300 equal vectors is several cells
    got = A.neighbours(table(spark, tmp_path, x), lists=lists).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 35
    assert not (got.query_id == got.vec_id).any() and not got.duplicated(["query_id", "vec_id"]).any()


@pytest.mark.parametrize("kind", ["long", "beside", "wide"])
def test_no_nearest_vector_is_missed(spark, tmp_path, kind):
    """Vectors of very unequal lengths, far from zero and close together, of many dimensions: all nearest are found with few rows spent on the floor, too."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2_500, 160 if kind == "wide" else 24))
    if kind == "long":
        x *= np.exp(rng.normal(size=(2_500, 1)))
    elif kind == "beside":
        x = 0.05 * x + rng.normal(size=24)
    x[300:340] = x[300]  # ties
    got = A.neighbours(table(spark, tmp_path, x), every=50, lists=160, rerank=100).toPandas().sort_values(["query_id", "rank"])
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id")} == brute(x, range(0, 2_500, 50))
