"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are joined: the text (hashed letter trigrams, counted by language over a labelled table), the
language that the markup declares, the address suffix, and the host. How reliable declarations and suffixes are is counted
from the pages themselves by grouped aggregation of the texts' posteriors. Host priors are smoothed hierarchically: a
host's counts towards its domain's, a domain's towards all pages'. A page's own share is left out of both.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, durable, slices

BUCKETS = 1 << 15
#: Trigrams beyond which a text's likelihood counts no more: neighbours are not independent.
EVIDENCE = 60
#: Pseudo-counts of declarations and suffixes, and of the host levels.
SMOOTH, LEVEL = 1.0, 5.0

#: Heads of what is not shown, up to the end that each asks for; without that end they are tags like any other.
HIDDEN = re.compile(r"<(script|style|noscript|template)\b|<!--", re.IGNORECASE)
ENDS = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.IGNORECASE)
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[[*range(33), *range(33, 65), *range(91, 97), *range(123, 128)]] = 32


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of a text: letters lower-cased, all else a space."""
    x = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    if len(x) < 3:
        return np.empty(0, np.int64)
    return ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def dropped(page: str) -> str:
    """The page without hidden parts, in time proportional to its length: an end that is missing is looked for once."""
    out, at, missing = [], 0, set()
    for head in HIDDEN.finditer(page):
        kind = (head[1] or "").lower()
        if head.start() < at or kind in missing:
            continue
        end = ENDS[kind].search(page, head.end())
        if end is None:
            missing.add(kind)
            continue
        out += [page[at : head.start()], " "]
        at = end.end()
    return "".join([*out, page[at:]])


def visible(page: str) -> str:
    return html.unescape(TAG.sub(" ", dropped(page)))


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (lang, bucket, n) of a task's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), binaries(batch.column("text")), strict=True):
            if lang and text:
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])


def text_logs(logs: np.ndarray):
    """Arrow function: (page_id, host, domain, suffix, declared, logs) with the text's log-likelihoods by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            declared, found = [], []
            for page in batch.column("html").to_pylist():
                page = page or ""
                said = DECLARED.search(page[: page.find(">", page.lower().find("<html")) + 1])
                declared.append(said[1].lower() if said else "")
                t = trigrams(visible(page).encode())
                found.append((logs[:, t].sum(axis=1) * min(1.0, EVIDENCE / len(t))).tolist() if len(t) else [0.0] * len(logs))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "host", "domain", "suffix")), pa.array(declared), pa.array(found, pa.list_(pa.float64()))], names=["page_id", "host", "domain", "suffix", "declared", "logs"])

    return run


def posterior(logs: Column) -> Column:
    """Normalised probabilities of an array of logarithms."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def summed(df: DataFrame, keys: list[str], column: str, size: int, alias: str) -> DataFrame:
    """Element-wise sums of an array column by ``keys``."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.get(column, F.lit(i))).alias(f"_{i}") for i in range(size)])
    return sums.select(*keys, F.array(*[f"_{i}" for i in range(size)]).alias(alias))


def page_languages(pages: DataFrame, labelled: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (page_id, lang, confidence, text_lang, declared, host), one for each page; languages are those of ``labelled``.

    Null or empty pages have no text evidence, null or malformed addresses the empty host, and pages without a declaration the
    empty one, itself evidence like any other. Ties go to the language that sorts first. Null ids stay null and repeated rows stay. Rows of
    ``labelled`` without language or text teach nothing; without any labelled row the language is null. Empty pages give no rows.
    """
    taught = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    grams = taught.mapInArrow(counts_of, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(grams.column("lang").to_pylist()))
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumns({"domain": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1), "suffix": F.regexp_extract("host", r"([^.]*)$", 1)})
    if not langs:
        empty = F.lit(None).cast("string")
        return rows.select("page_id", empty.alias("lang"), F.lit(None).cast("double").alias("confidence"), empty.alias("text_lang"), empty.alias("declared"), "host")
    k = len(langs)
    counts = np.zeros((k, BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in grams.column("lang").to_pylist()], grams.column("bucket").to_numpy()] = grams.column("n").to_numpy()
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))

    read = durable(rows.mapInArrow(text_logs(logs), "page_id long, host string, domain string, suffix string, declared string, logs array<double>").withColumn("post", posterior(F.col("logs"))), "language-texts")
    names = F.array(*map(F.lit, langs))
    overall = F.array(*[F.lit(x) for x in (summed(read, [], "post", k, "all").head() or [[0.0] * k])[0] or [0.0] * k])
    means = F.transform(overall, lambda x: (x + 1.0))
    total = F.aggregate(means, F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(means, lambda x: x / total)

    said = summed(read, ["declared"], "post", k, "said").withColumn("said_logs", F.zip_with("said", overall, lambda x, n: F.log((x + SMOOTH) / (n + SMOOTH * (k + 1)))))
    suffixes = summed(read, ["suffix"], "post", k, "suffix_n").withColumn("suffix_logs", F.zip_with("suffix_n", overall, lambda x, n: F.log((x + LEVEL) / (n + LEVEL * (k + 1)))))
    by_host, by_domain = summed(read, ["host", "domain", "suffix"], "post", k, "host_n"), summed(read, ["domain"], "post", k, "domain_n")

    def blended(counts: Column, own: Column, above: Column) -> Column:
        """Counts without the page's own share, with ``LEVEL`` pseudo-counts of the level above."""
        rest = F.zip_with(counts, own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
        n = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(rest, above, lambda x, p: (x + LEVEL * p) / (n + LEVEL))

    fused = read.join(by_host.drop("domain", "suffix"), "host").join(by_domain, "domain").join(suffixes.select("suffix", "suffix_logs"), "suffix").join(said.select("declared", "said_logs"), "declared")
    prior = blended(F.col("host_n"), F.col("post"), blended(F.col("domain_n"), F.col("post"), shares))
    fused = fused.withColumn("prior", prior).withColumn("logs", F.zip_with(F.zip_with("logs", "said_logs", lambda a, b: a + b), F.zip_with("suffix_logs", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), lambda a, b: a + b))
    fused = fused.withColumn("final", posterior(F.col("logs")))

    def best(p: str) -> Column:
        return F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)

    return fused.select("page_id", best("final").alias("lang"), F.array_max("final").alias("confidence"), best("post").alias("text_lang"), "declared", "host")
