"""Smoothed shares between two roundings are rounded up, in whatever order they are added."""

from fractions import Fraction

import duckdb
import pytest

from lodestar.plans import registry

STEPS = (10, 5)


def smoothed(h: dict, compat: bool) -> dict:
    """Exact shares by bin of one histogram."""
    total, out = sum(h.values()), {}
    for (x, y), n in h.items():
        near = [(x + a, y + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= x + a < STEPS[0] and 0 <= y + b < STEPS[1]]
        out[x, y] = out.get((x, y), 0) + Fraction(n, 2 * total)
        for b in near:
            out[b] = out.get(b, 0) + Fraction(n, 2 * total) / (2 if compat else len(near))
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_ties_round_up(spark, compat):
    sf, histograms = "/root/testdata/sf0.01", {}
    counts = duckdb.sql(registry.oracle_sql()["histo_feed"].replace("FROM lineitem", f"FROM '{sf}/lineitem.parquet'")).fetchall()
    for s, b, n in counts:
        histograms.setdefault(s, {})[b % 10, b // 10] = n
    want = {(s, *b): f * 10**6 for s, h in histograms.items() for b, f in smoothed(h, compat).items()}
    assert sum(f % 1 == Fraction(1, 2) for f in want.values()) >= 5
    got = {r[:3]: r[3] for r in map(tuple, registry.queries()[f"sparse_smooth{'_compat' * compat}"](spark, sf).collect())}
    assert got == {k: int(f + Fraction(1, 2)) / 10**6 for k, f in want.items()}
