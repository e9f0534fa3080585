import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows and ids, a very long text, odd characters; clashing extra columns."""
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, text), (1, text), (2, text.upper()), (3, None), (4, ""), (5, " \t\n "), (None, text), (None, None), (6, "one"), (7, "one"), (8, "x " * 60_000 + "end"),
        (9, "naïve é 日本語 \u0085   ıK"), (1, "another text with the same id " * 3), (10, text + " eleven"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Extra columns that bear names which operators use inside.
    return df.withColumns({c: F.lit(0) for c in ("n", "node", "h", "item_id", "row", "word", "rank", "task", "length", "score", "keep", "a", "b", "pattern", "digest", "lang", "source")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
