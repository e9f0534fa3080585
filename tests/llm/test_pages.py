"""Languages of pages whose declaration is missing or wrong, and hidden parts of pages, against plain definitions."""

import random
import re

import pandas as pd

from lodestar.llm.language_id import dropped, page_languages

SF = "/root/testdata/sf0.01"
PLAIN = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)


def test_languages_without_and_against_the_declaration(spark):
    """Texts of known language as pages: a third declares it, a third nothing, a third another one; hosts tell nothing."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = docs[docs.text.notna() & docs.lang.notna() & (docs.text.str.len() > 200)].drop_duplicates("doc_id")
    langs = sorted(docs.lang.unique())
    teach, ask = docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]
    said = [(None, x, langs[(langs.index(x) + 1) % len(langs)])[i % 3] for i, x in enumerate(ask.lang)]
    head = ["<html>" if x is None else f'<html lang="{x}">' for x in said]
    pages = pd.DataFrame({"page_id": ask.doc_id, "url": [f"http://h{i % 7}.example.org/{i}" for i in range(len(ask))], "html": [h + "<script>var x = 1;</script><p>" + t + "</p></html>" for h, t in zip(head, ask.text, strict=True)]})
    got = page_languages(spark.createDataFrame(pages), spark.createDataFrame(teach[["lang", "text"]])).toPandas().merge(ask, left_on="page_id", right_on="doc_id")
    right = got.lang_x == got.lang_y
    none, true, wrong = (right[got.declared == x] for x in ("",)) , right[got.declared == got.lang_y], right[(got.declared != got.lang_y) & (got.declared != "")]
    assert len(got) == len(ask) and next(iter(none)).mean() > 0.9 and true.mean() > 0.9 and wrong.mean() > 0.9


def test_hidden_parts_equal_the_plain_pattern():
    rng = random.Random(6)
    bits = ["<script>", "</script>", "<SCRIPT src=x>", "</script >", "<style>", "</style>", "<!--", "-->", "text ", "<p>", "<template>", "</template>", "<b"]
    for _ in range(3_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert dropped(page) == PLAIN.sub(" ", page), page


def test_many_heads_without_end_take_linear_time():
    page = "<!-- <script> " * 200_000
    assert dropped(page) == page
