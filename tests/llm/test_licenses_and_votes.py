"""Licence texts as they are wrapped in files, and weak labels against brute force."""

import collections
import itertools
import textwrap
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import licenses as L
from lodestar.llm.quality import HIGH, LOW, NONE, estimate, pattern


def test_known_texts_at_any_width(spark):
    rows, want = [], {}
    for (name, text), width in itertools.product(L.KNOWN, range(60, 101)):
        paragraphs = [textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n")]
        want[len(rows)] = name
        rows.append((len(rows), "Copyright (c) 2021, Some One <some@one.example>\n\n" + "\n".join(paragraphs)))
    got = {r["doc_id"]: r["license"] for r in L.license_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_copyright_lines_and_adjacent_words(spark):
    body = "first words here\n{}\nlast words here"
    lines = ["Copyright (c) 2001 A", "copyright 1999, 2000 B", " * Copyright by C", "(c) 2003 D", "\u00a9 E", "All rights reserved.", "Copyright (C) <year> F"]
    kept = ["copyright notice, this list of conditions", "(c) You must retain notices", "licence licence licence owner owner"]
    rows = [(0, "first words here\nlast words here")] + [(k, body.format(x)) for k, x in enumerate(lines, 1)]
    rows += [(100 + k, body.format(x)) for k, x in enumerate(kept)] + [(200, body.format("license License LICENSE holder holder"))]
    got = {r["doc_id"]: r["digest"] for r in L.license_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[k] for k in range(len(lines) + 1)}) == 1
    assert len({got[0], *(got[100 + k] for k in range(3))}) == 4 and got[102] == got[200]


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_whole_texts_of_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    texts = {k: Path("/usr/share/common-licenses", k).read_text() for k in names}
    rows = [(k, x) for k, x in texts.items()] + [(k + " cut", x[: -len(x) // 3]) for k, x in texts.items()] + [("GPL-2 upper", texts["GPL-2"].upper())]
    got = {r["doc_id"]: r["license"] for r in L.license_digests(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [*names.values(), *[None] * len(names), "GPL-2.0"]


def brute_em(votes, rounds=400):
    """The same model over rows instead of patterns, with the operator's pseudo-counts."""
    from lodestar.llm.quality import PSEUDO

    k = votes.shape[1]
    share, table = np.array([0.15, 0.85]), np.array([[[0.4, 0.6]] * k, [[0.03, 0.97]] * k])
    prior = PSEUDO * table
    for _ in range(rounds):
        p = np.tile(share, (len(votes), 1))
        for i in range(k):
            for v, at in ((LOW, 0), (HIGH, 1)):
                p[votes[:, i] == v] *= table[:, i, at]
        p /= p.sum(axis=1, keepdims=True)
        share = (p.sum(axis=0) + 1) / (len(votes) + 2)
        for i in range(k):
            n = np.stack([p[votes[:, i] == v].sum(axis=0) for v in (LOW, HIGH)], axis=1) + prior[:, i]
            table[:, i] = n / n.sum(axis=1, keepdims=True)
    return p[:, 1], table


@pytest.mark.parametrize("rare", [0.02, 0.5])
def test_weak_labels_equal_rowwise_estimation(rare):
    """A perfect labeller that seldom votes is found to be one, and the posteriors equal those of the model over rows."""
    rng = np.random.default_rng(3)
    n = 20_000
    y = rng.random(n) < 0.8
    votes = np.full((n, 5), NONE)
    for i, (coverage, accuracy) in enumerate([(rare, 1.0), (0.9, 0.9), (0.8, 0.85), (0.9, 0.8), (0.7, 0.9)]):
        on, right = rng.random(n) < coverage, rng.random(n) < accuracy
        votes[on, i] = np.where((y == right)[on], HIGH, LOW)
    codes = [pattern(tuple(v)) for v in votes]
    post, table = estimate(collections.Counter(codes), 5)
    want, brute = brute_em(votes)
    assert np.abs(np.array([post[c] for c in codes]) - want).max() < 1e-3
    assert np.abs(table[:, :, [LOW, HIGH]] - brute).max() < 1e-3
    assert table[0, 0, LOW] > 0.75 and np.abs(table[1, 1:, HIGH] - [0.9, 0.85, 0.8, 0.9]).max() < 0.05
