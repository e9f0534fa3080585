"""Quality classifier: a weak-label model teaches a hashed linear scorer.

Heuristic labellers look at each text and vote low, high or not at all. Only the counts of vote patterns
(3 to the power of the number of labellers at most, over all rows) reach the driver, where expectation-maximisation
estimates how each labeller that votes does so on low and on high texts, and with that the posterior of
each pattern; not voting says nothing. The posteriors are soft labels of a bounded sample of rows, on which a logistic model over
hashed words, word shapes and votes is trained. The model scores every row; rows below the threshold are rejected.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import CACHED_LENGTH, slices

#: Rows of which the scorer is trained, at most.
SAMPLE = 8_000
BUCKETS = 1 << 14
#: Distinct words whose weights a worker remembers.
CACHE = 100_000

LOW, NONE, HIGH = 0, 1, 2
UPPERS, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
SYMBOLS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,'-\"")
RUNS = re.compile(rb"[!-&*+:-@\[-`{-~]{2,}")
#: Frequent function words of the languages that are expected (fixed values).
FUNCTION_WORDS = frozenset(
    b"a an and are as at be by for from he in is it of on or that the this to was with "
    b"au das de del dem den der des die du ein eine el en est et il ist la las le les los mit nicht no of ou para pas por pour "
    b"que qui se sich sie su sur un una und une von y zu".split()
)


def _between(x: float, high_to: float, low_from: float) -> int:
    return HIGH if x <= high_to else LOW if x >= low_from else NONE


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """The labellers' votes on a text with at least one word."""
    n, size = len(words), len(text)
    letters = size - len(text.translate(None, LETTERS))
    upper = size - len(text.translate(None, UPPERS))
    symbols = size - len(text.translate(None, SYMBOLS))
    repeated = sum(map(operator.eq, words, words[1:])) / n
    runs = [sum(1 for _ in same) for _, same in groupby(words)] if repeated > 0.02 else [1]
    distinct = len(set(words)) / n
    known = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    stops = text.count(b".") / n
    mean = size / n
    return (
        _between(symbols / size, 0.01, 0.05),
        _between(upper / max(letters, 1), 0.2, 0.5),
        _between(len(RUNS.findall(text)) / n, 0.01, 0.15),
        _between(words.count(b"|") / n, 0.0, 0.1),
        _between(repeated, 0.03, 0.2),
        _between(max(runs), 2, 5),
        _between(sum(x for x in runs if x > 2) / n, 0.01, 0.2),
        NONE if n < 20 else LOW if distinct < 0.15 else HIGH if distinct > 0.3 else NONE,
        NONE if n < 30 else HIGH if known >= 0.08 else LOW if known < 0.02 else NONE,
        NONE if n < 30 else HIGH if 0.01 <= stops <= 0.5 else LOW,
        HIGH if 3 <= mean <= 12 else LOW if mean > 25 else NONE,
    )


LABELLERS = 11
#: Votes that a labeller is taken to have cast in each class as at the start, whatever the table's size.
PSEUDO = 20.0


def pattern(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = 3 * code + x
    return code


SHAPES = bytes.maketrans(bytes(range(256)), bytes(120 if 97 <= x < 123 or x >= 128 else 88 if 65 <= x < 91 else 57 if 48 <= x < 58 else x for x in range(256)))


def word_buckets(word: bytes) -> tuple[int, int, int]:
    """The word itself, its shape with runs shortened, and its last two characters' shape."""
    shape = re.sub(rb"(.)\1{2,}", rb"\1\1", word.translate(SHAPES), flags=re.DOTALL)[:12]
    return tuple(xxhash.xxh3_64_intdigest(x) % BUCKETS for x in (b"w" + word.lower(), b"s" + shape, b"e" + shape[-2:]))


def vote_buckets(v: tuple[int, ...]) -> list[int]:
    """One bucket for each labeller that votes."""
    return [xxhash.xxh3_64_intdigest(b"v%d:%d" % (i, x)) % BUCKETS for i, x in enumerate(v) if x != NONE]


REPEATED = xxhash.xxh3_64_intdigest(b"repeated") % BUCKETS


def votes_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the vote pattern of each text, -1 for one without words."""
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t, w)) if t and (w := t.split()) else -1 for t in texts], pa.int32())], names=["pattern"])


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the vote pattern and the hashed features of each text with words."""
    for batch in slices(batches):
        patterns, buckets, values = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            if not words:
                continue
            total = Counter({REPEATED: sum(map(operator.eq, words, words[1:]))})
            for word, n in Counter(words).items():
                for b in word_buckets(word):
                    total[b] += n
            v = votes(text, words)
            for b in vote_buckets(v):
                total[b] += len(words)
            patterns.append(pattern(v))
            buckets.append(np.fromiter(total.keys(), np.int32, len(total)).tobytes())
            values.append((np.fromiter(total.values(), np.float32, len(total)) / np.float32(len(words))).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int32()), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], names=["pattern", "buckets", "weights"])


def estimate(counts: dict[int, int], labellers: int = LABELLERS, rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of "high" for each pattern, and P(vote | class, votes) as an array (class, labeller, vote)."""
    codes = sorted(counts)
    if not codes:
        return {}, np.zeros((2, labellers, 3))
    n = np.array([counts[c] for c in codes], float)
    seen = np.array([[c // 3 ** (labellers - 1 - i) % 3 for i in range(labellers)] for c in codes])
    share = np.array([0.15, 0.85])
    table = np.tile(np.array([[[0.4, 1.0, 0.6]], [[0.03, 1.0, 0.97]]]), (1, labellers, 1))  # not voting is no evidence
    prior, post = PSEUDO * table, None  # keeps the meaning of each labeller's votes where they are few
    for _ in range(rounds):
        logs = np.log(share)[None, :] + sum(np.log(table[:, i, :]).T[seen[:, i]] for i in range(labellers))
        logs -= logs.max(axis=1, keepdims=True)
        now = np.exp(logs)
        now /= now.sum(axis=1, keepdims=True)
        done = post is not None and np.abs(now - post).max() < 1e-6
        post = now
        if done:
            break
        weight = post * n[:, None]
        share = (weight.sum(axis=0) + 1) / (n.sum() + 2)
        for i in range(labellers):
            low, high = (weight[seen[:, i] == v].sum(axis=0) + prior[:, i, v] for v in (LOW, HIGH))
            table[:, i, LOW], table[:, i, HIGH] = low / (low + high), high / (low + high)
    return dict(zip(codes, post[:, 1].tolist(), strict=True)), table


def train(rows: list[tuple[bytes, bytes, float]], rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model over (buckets, values, soft label), classes balanced."""
    if not rows:
        return np.zeros(BUCKETS), 0.0
    at = [np.frombuffer(x[0], np.int32) for x in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in at])
    at, value, y = np.concatenate(at), np.concatenate([np.frombuffer(x[1], np.float32) for x in rows]).astype(float), np.array([x[2] for x in rows])
    each = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    w, b, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[at], minlength=len(rows)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * each
        g = np.append(np.bincount(at, weights=value * gap[doc], minlength=BUCKETS) + decay * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


SCORED = "weak_posterior double, score double, keep boolean"


def score_rows(keys: list[str], posteriors: dict[int, float], weights: np.ndarray, bias: float, threshold: float):
    """Arrow function: the columns ``keys`` and the scores of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Weights(dict):
            def __missing__(self, word: bytes) -> float:
                x = float(weights[list(word_buckets(word))].sum())
                if len(word) <= CACHED_LENGTH:
                    if len(self) >= CACHE:
                        self.clear()
                    self[word] = x
                return x

        known = Weights()
        for batch in slices(batches):
            post, score = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                if not words:
                    post.append(0.0)
                    score.append(0.0)
                    continue
                v = votes(text, words)
                post.append(posteriors.get(pattern(v), 0.5))
                z = bias + weights[vote_buckets(v)].sum() + (sum(map(known.__getitem__, words)) + weights[REPEATED] * sum(map(operator.eq, words, words[1:]))) / len(words)
                score.append(1 / (1 + float(np.exp(-np.clip(z, -50, 50)))))
            keep = pa.array([x >= threshold for x in score], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(post, pa.float64()), pa.array(score, pa.float64()), keep], names=[*keys, "weak_posterior", "score", "keep"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """The pattern posteriors over all rows, and the scorer trained on at most ``sample`` rows chosen by a hash of the id."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {x["pattern"]: x["n"] for x in texts.mapInArrow(votes_rows, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    counts.pop(-1, None)
    posteriors, _ = estimate(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else docs
    rows = chosen.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sample_rows, "pattern int, buckets binary, weights binary").limit(sample).collect()
    if not rows and counts:  # few distinct ids, none of which the hash chose: the first rows
        rows = texts.mapInArrow(sample_rows, "pattern int, buckets binary, weights binary").limit(sample).collect()
    weights, bias = train([(bytes(x["buckets"]), bytes(x["weights"]), posteriors[x["pattern"]]) for x in rows])
    return posteriors, weights, bias


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, weak_posterior, score, keep), one for each input row.

    A null text, or one without words, has scores 0 and is rejected. Null ids stay null, repeated rows
    stay and score alike, an empty table gives no rows, other columns are not read.
    """
    model = fit(docs, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score_rows(["doc_id"], *model, threshold), f"doc_id long, {SCORED}")


def keep_good(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) that the classifier keeps, all columns as they are."""
    model = fit(docs, "doc_id", "text", sample)
    scored = score_rows(docs.columns, *model, threshold)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scored(batches):
            yield batch.filter(batch.column(batch.num_columns - 1)).select(list(range(batch.num_columns - 3)))

    return docs.mapInArrow(kept, docs.schema)
