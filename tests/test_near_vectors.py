"""Neighbour counts and density clusters by packs against brute force."""

import numpy as np
import pytest

from lodestar.operators import clustering as C


def vectors() -> list:
    rng = np.random.default_rng(6)
    wide = [(i, (np.round(rng.normal(size=3), 1) + 4 * rng.integers(0, 3, 3)).tolist()) for i in range(240)]
    line = [(300 + i, [0.5 * i]) for i in range(5)] + [(310, [40.0])]
    return [*wide, *wide[:30], *[(400 + i, v) for i, v in wide[:20]], *line, (500, None), (501, [float("nan"), 0.0, 0.0]), (502, [float("inf"), 0.0, 0.0]), (503, [None, 0.0, 0.0])]


def near(rows: list, epsilon: float) -> list:
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in usable:
        for j, w in usable:
            total = 0.0
            for x, y in zip(v, w, strict=False):
                total += (x - y) * (x - y)
            if len(v) == len(w) and total <= epsilon:
                out.append((i, j))
    return out


@pytest.mark.parametrize("epsilon", [0.25, 0.5, 0.0])
def test_packs_by_brute_force(spark, monkeypatch, epsilon):
    monkeypatch.setattr(C, "PACK", 16)
    monkeypatch.setattr(C, "SIDE", 64)
    rows = vectors()
    df = spark.createDataFrame(rows, "idx long, v array<double>").repartition(3)
    pairs = near(rows, epsilon)
    counts = {}
    for i, _ in pairs:
        counts[i] = counts.get(i, 0) + 1
    assert {r["idx"]: (r["n"], r["core"]) for r in C.neighbour_counts(df, "v", epsilon, 4).collect()} == {i: (n, n >= 4) for i, n in counts.items()}
    cluster = {i: i for i, n in counts.items() if n >= 4}
    while True:
        after = dict(cluster)
        for i, j in pairs:
            if i in after and j in after:
                after[i] = min(after[i], after[j])
        if after == cluster:
            break
        cluster = after
    want = {i: cluster.get(i) for i, _ in rows}
    for i, j in pairs:
        if i not in cluster and j in cluster:
            want[i] = cluster[j] if want[i] is None else min(want[i], cluster[j])
    got = C.dbscan(df, "v", epsilon, 4).collect()
    assert sorted(r["idx"] for r in got) == sorted(i for i, _ in rows)
    assert {r["idx"]: r["cluster"] for r in got} == want
