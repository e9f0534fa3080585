"""The pipeline's stages against brute force on what the stage before kept."""

import re

import pandas as pd

import corpus_pipeline as P
from test_brute_force import brute_components, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        docs = P.durable(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs.toPandas()
    table = pd.read_parquet(f"{SF}/documents.parquet")
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        assert list(kept[name].columns) == list(table.columns)
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(kept["quality"], on="doc_id", how="left", indicator=True)
    assert (labels[labels.quality == 1]._merge == "both").mean() > 0.95 and (labels[labels.quality == 0]._merge == "both").mean() < 0.2

    before = dict(zip(kept["quality"].doc_id, kept["quality"].text, strict=True))
    want = {i for i, (_, c) in brute_components(before).items() if i == c}
    assert set(kept["near_duplicates"].doc_id) == want

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    items = [grams(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    clean = {i for i, t in zip(kept["near_duplicates"].doc_id, kept["near_duplicates"].text, strict=True) if not any(len(q & (g := grams(t))) >= 0.8 * len(q) for q in items)}
    assert set(kept["decontamination"].doc_id) == clean

    s = kept["secrets"]
    assert set(s.doc_id) == clean and (s.n_chars == s.text.str.len()).all()
    assert not s.text.str.contains(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", regex=True).any()
    assert check_packing(kept["packing"], dict(zip(s.doc_id, s.text, strict=True))) < 0.05
    assert set(kept["packing"].doc_id) == clean


def test_stages_on_odd_rows(spark, odd):
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        assert name == "packing" or out.columns == odd.columns
        out.count()
        stage(spark, odd.limit(0), SF).count()
    one = P.near_duplicates(spark, odd, SF).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count()
    assert one == 0


def test_near_duplicates_by_five_words(spark):
    """A changed word in 50: 41 of 51 shingles of five words are shared (80 %), 43 of 51 of four words (84 %)."""
    words = [f"word{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join([*words[:20], "one", *words[21:30], "two", *words[31:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()} == {1, 3}
    assert {r["doc_id"]: r["component_id"] for r in P.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3}
