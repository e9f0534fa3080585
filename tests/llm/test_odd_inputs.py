"""Every operator on odd rows, and on empty tables."""

import hashlib

import pytest

from lodestar.llm import registry as G
from lodestar.llm.additive_quantization import neighbours
from lodestar.llm.class_lm import lm_scores
from lodestar.llm.decontamination import contained_items
from lodestar.llm.jaccard_join import jaccard_components
from lodestar.llm.language_id import page_languages
from lodestar.llm.licenses import license_digests
from lodestar.llm.packing import pack
from lodestar.llm.quality import keep_good, quality_scores
from lodestar.llm.secrets import redact_secrets, secret_spans
from lodestar.llm.token_counts import token_counts

BYTES, PIECES = G.tokenizer("byte_bpe_50k.json"), G.tokenizer("piece_bpe_32k.model")
ROWWISE = {
    "quality": quality_scores, "secrets": secret_spans, "jaccard": jaccard_components, "tokens": lambda d: token_counts(d, PIECES),
    "lm": lm_scores, "licenses": license_digests,
}


@pytest.mark.parametrize("name", ROWWISE)
def test_one_row_for_each(odd, none, name):
    out = ROWWISE[name](odd).toPandas()
    ids = sorted(odd.toPandas()["doc_id"].fillna(-1))
    assert sorted(out["doc_id"].fillna(-1)) == ids
    assert ROWWISE[name](none).count() == 0


def test_quality_of_odd_rows(odd):
    rows = quality_scores(odd).collect()
    assert all(not r["keep"] and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    kept = keep_good(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0


def test_secrets_of_odd_rows(odd):
    rows = {r["doc_id"]: r for r in secret_spans(odd).collect()}
    assert rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    assert redact_secrets(odd).count() == odd.count()


def test_jaccard_of_odd_rows(odd):
    rows = jaccard_components(odd).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert of[1] == [(7, 1), (7, 1), (9, 1)] or sorted(of[1]) == [(7, 1), (7, 1), (9, 1)] or [c for _, c in of[1]] == [1, 1, 1]
    assert of[2] == [(7, 1)] and of[10] == [(8, 1)]  # 7 of 8 shingles are shared
    assert of[3] == of[4][:0] + [(0, 3)] and of[4] == [(0, 4)] and of[5] == [(0, 5)]
    assert of[6] == [(1, 6)] and of[7] == [(1, 6)]
    assert [c for _, c in of[None]] == [None, None]
    assert of[8][0][1] == 8


def test_tokens_of_odd_rows(odd):
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts(odd, PIECES).collect()}
    assert rows[3] == rows[4] == 0 and rows[8] > 60_000


def test_lm_of_odd_rows(odd, spark):
    rows = lm_scores(odd).collect()
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in rows)
    # No training rows at all: every token is unknown.
    held = next(i for i in range(1000) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    only = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).head()
    assert only["held_out"] and only["n_known"] == 0 and only["train_tokens"] == 0 and only["base_score"] == 0


def test_packing_of_odd_rows(odd, none):
    rows = pack(odd, BYTES).toPandas()
    assert (rows[rows.doc_id.isin([3, 4])].doc_tokens == 1).all()
    assert pack(none, BYTES).count() == 0


def test_decontamination_of_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "Two THREE four, five six"), (2, None), (3, ""), (None, "one two"), (4, "one"), (1, "Two THREE four, five six"), (5, "absent words here"), (6, "nine ten")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_found"], r["containment"]) for r in contained_items(odd, items).collect()}
    assert found == {**{(d, 1): (1, 1, 1.0) for d in (1, 2, 10)}, **{(d, 4): (1, 1, 1.0) for d in (1, 2, 6, 7, 10)}, **{(d, 6): (1, 1, 1.0) for d in (1, 2, 10)}}
    assert contained_items(none, items).count() == 0 and contained_items(odd, items.limit(0)).count() == 0


def test_languages_of_odd_rows(odd, none, spark, docs):
    pages = spark.createDataFrame([(1, "http://a.example.com/x", '<html lang="fr"><p>le la les des une dans est</p>'), (1, None, None), (None, "nonsense", ""), (2, "http://a.example.com/y", "<html><p>the and that with for this")], "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS lang")
    out = page_languages(pages, docs).collect()
    assert len(out) == 4 and all(r["lang"] in ("en", "fr", "de", "es") for r in out)
    assert page_languages(pages.limit(0), docs).count() == 0
    assert [r["lang"] for r in page_languages(pages, none).collect()] == [None] * 4


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (2, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS v", "0 AS list", "0 AS part", "0 AS rank")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours(df).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours(df.limit(0)).count() == 0
