"""Every query with SQL equals DuckDB's answer; the others give rows."""

import duckdb
import pandas as pd
import pytest

from lodestar.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name not in registry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=2e-6)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
