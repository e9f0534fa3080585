"""Queries without SQL read all objects, not the first ones."""

import numpy as np
import pandas as pd
import pytest

from lodestar.plans import registry

N = 60


@pytest.fixture(scope="module")
def small_sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    rng = np.random.default_rng(4)
    pd.DataFrame({"vec_id": range(N), "label": [i % 3 for i in range(N)], "embedding": list(rng.normal(size=(N, 64)).astype("float32"))}).to_parquet(at / "embeddings.parquet")
    words = ["blue", "green", "ivory", "lace", "misty", "navy", "olive", "peru"]
    names = [" ".join(rng.choice(words, 2, replace=False)) for _ in range(12)]
    pd.DataFrame({"p_partkey": [*range(1, 7), *range(300, 306)], "p_name": names}).to_parquet(at / "part.parquet")
    return str(at)


@pytest.mark.parametrize(
    "name", ["invariant", "relational", "invariant_monomial1", "invariant_monomial3", "local_dog", "local_orientation", "position_clusters", "tamura_pairs", "hungarian", "idm", "xcorr", "emd"]
)
def test_all_objects(spark, small_sf, name):
    got = registry.queries()[name](spark, small_sf).toPandas()
    assert set(got.idx) == set(range(N))
    if "q" in got.columns:
        assert len(got) == 2 * N


def test_stemmed_overlap_by_brute_force(spark, small_sf):
    parts = pd.read_parquet(f"{small_sf}/part.parquet")
    sets = {k: set(n.split()) for k, n in zip(parts.p_partkey, parts.p_name, strict=True)}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    got = registry.queries()["gt_stemmed_overlap"](spark, small_sf).select("q", "idx").toPandas()
    assert set(map(tuple, got.to_numpy().tolist())) == want
    assert len(got) == len(want)
