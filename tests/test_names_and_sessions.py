"""Distances by name, sessions with all commands, metrics of queries with several examples, and models, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.operators import clustering as C
from lodestar.operators import named as N
from lodestar.operators import retrieval as R
from lodestar.operators import sparse as SP
from lodestar.plans.fixtures import objects
from lodestar.plans.session import Session

TEXTS = ["red fish swims", "blue fish", "red red stone in the river", "nothing of that kind", None]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"t{i}", i % 2, text, "en" if i % 2 else "fr") for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "idx long, name string, class int, text string, lang string")


def test_every_name_gives_all_pairs(spark, sf):
    o = objects(spark, sf).where("idx < 12")
    asked = spark.createDataFrame([(0, 0, 1), (0, 3, -1)], "qid int, idx long, sign int")
    for column, spec in (("lf", "lfhungarian"), ("lf", "lfsigemd"), ("lf", "glfd:K=5"), ("image", "idm"), ("image", "crosscorrelation:D=2"), ("v", "l1"), ("h", "jsd"), ("flag", "")):
        got = N.distances(o, asked, [(column, spec), ("v", "euclidean")]).toPandas()
        assert len(got) == 24 and got.d0.notna().all() and set(got.sign) == {1, -1}, spec


def test_text_distances(documents, spark):
    asked = spark.createDataFrame([(0, 0, 1), (0, 4, 1)], "qid int, idx long, sign int")
    got = {(r["q"], r["idx"]): r["d0"] for r in N.distances(documents, asked, [("text", "textfeature")]).collect()}
    assert len(got) == 10 and all(got[4, i] == SP.NOTHING_FOUND for i in range(5))
    assert got[0, 3] == got[0, 4] == max(got[0, i] for i in range(5)) and min(got[0, i] for i in range(5)) == 0
    tfidf = {(r["q"], r["idx"]): r["d0"] for r in N.distances(documents, asked, [("text", "tfidf")]).collect()}
    assert tfidf[0, 0] == pytest.approx(0) and tfidf[0, 1] == pytest.approx(1 - math.sqrt(1 / 3 * 1 / 2)) and tfidf[0, 3] == 1


def test_smoothed_maps(spark):
    rows = [(0, {(0, 0): 1.0}), (1, {(1, 0): 0.5, (2, 2): 0.5})]
    long = spark.createDataFrame([(i, list(k), v) for i, m in rows for k, v in m.items()], "idx long, bin array<int>, f double")
    o = long.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("bin", "f"))).alias("m"))
    asked = spark.createDataFrame([(0, 0, 1)], "qid int, idx long, sign int")

    def smooth(m):
        out = {}
        for (x, y), f in m.items():
            near = [(a, b) for a, b in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if 0 <= a < 3 and 0 <= b < 3]
            for k, v in [((x, y), f / 2), *(((n), f / 2 / len(near)) for n in near)]:
                out[k] = out.get(k, 0) + v
        return out

    def jsd(a, b):
        return sum(x * math.log(2 * x / (x + y)) if x else 0 for k in a.keys() | b.keys() for x, y in ((a.get(k, 0), b.get(k, 0)), (b.get(k, 0), a.get(k, 0))))

    for spec, change in (("jsd:STEPS=3x3", smooth), ("jsd:SF=0", dict)):
        got = {r["idx"]: r["d0"] for r in N.distances(o, asked, [("m", spec)]).collect()}
        assert got == pytest.approx({i: jsd(change(m), change(rows[0][1])) for i, m in rows}, abs=1e-12)
    with pytest.raises(ValueError):
        N.distances(o, asked, [("m", "jsd:SF=-1:STEPS=3x3")])


def test_text_and_meta_pages_in_a_session(documents, spark, tmp_path):
    o = documents.withColumn("meta", F.create_map(F.lit("kind"), F.col("class").cast("string")))
    s = Session(o, [("text", "bm25")], results=1, meta_column="meta", texts=documents, relevance_path=f"file://{tmp_path}/rel")
    first, second = s.command("textretrieve red fish").head(), s.command("textexpand 1 red fish").head()
    assert first["name"] == "t0" and (first["rank"], second["rank"]) == (1, 2) and second["name"] != "t0"
    both = s.command('textretrieve Fr:"red stone" En:"fish"').head()
    assert both["name"] in ("t1", "t2") and SP.language_parts('En:"a b" Fr:"c"') == [("en", "a b"), ("fr", "c")] and SP.language_parts("a b") == []
    with pytest.raises(ValueError):
        SP.language_parts('En:"a" b')
    assert [s.command(f"metaexpand {k} kind:1").head()["name"] for k in (0, 1)] == ["t3", "t1"]
    for line in ("saverelevances +t0", "saverelevances -t1"):
        assert s.command(line) == "ok"
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/rel").collect()) == ["saverelevances +t0", "saverelevances -t1"]
    assert s.command("feature t1 text").head()["text"] == TEXTS[1]
    s.command("setextensions 1")
    assert s.command("textretrieve stone").head()["name"] == "t2"


def test_scorings_and_lists_in_a_session(spark, sf, tmp_path):
    s = Session(objects(spark, sf), [("v", "euclidean"), ("h", "jsd")], [1.0, 0.5])
    linear = [tuple(r) for r in s.command("retrieve o0 o1").collect()]
    (tmp_path / "w").write_text("nofweights 2\nweights 1.0 0.5\n")
    (tmp_path / "svm").write_text("nofweights 3\nweights -1.0 -0.5 0.0\n")
    (tmp_path / "me").write_text("2 1.0 0.0 2 2 1\n0.5 0.2 0.1\n-0.5 -0.2 -0.1\n")
    for config in ("linear:CONFIG=file://" + str(tmp_path / "w"), "svm:CONFIG=file://" + str(tmp_path / "svm")):
        assert s.command(f"setscoring {config}") == "ok"
        got = [tuple(r) for r in s.command("retrieve o0 o1").collect()]
        assert [r[:2] for r in got] == [r[:2] for r in linear] and [r[2] for r in got] == pytest.approx([r[2] for r in linear])
    s.command("setscoring maxent:CONFIG=file://" + str(tmp_path / "me"))
    assert 0 < s.command("retrieve o0").head()["score"] < 1
    for bad in ("setscoring maxent", "setscoring nonsense", "setcombiner nonsense", "setdist 0 nonsense", "setdist 0 l1:NO=1"):
        with pytest.raises(ValueError):
            s.command(bad)
    assert s.command("setdist 0 l1") == s.command("setscoring nnquot") == "ok" and s.combiner == "nnquot"
    (tmp_path / "list").write_text("classes yes\npath here\nsuffix v\nfile o5 7\nfile o2 8\n")
    s.command(f"filelist file://{tmp_path / 'list'}")
    assert [r["name"] for r in s.command("listfiles").collect()] == ["o5", "o2"] and s.command("class o2").head()["class"] == 8


def test_cascade_equals_whole_rows(spark, sf):
    """Three stages, one feature twice, against the definition on whole rows of pandas."""
    o = objects(spark, sf)
    asked = [(0, 0, 1), (0, 5, -1), (1, 7, 1)]
    features, weights, stages = [("v", D.euclidean), ("h", D.jsd), ("v", D.l1)], [1.0, 0.5, 0.7], [(1, 60), (0, 25), (2, 5)]
    got = {(r["qid"], r["idx"]): r["score"] for r in R.cascade(o, spark.createDataFrame(asked, "qid int, idx long, sign int"), stages, features, weights).collect()}
    d = R.distances(o, spark.createDataFrame(asked, "qid int, idx long, sign int"), features).toPandas()
    want = {}
    for (qid, q), t in d.groupby(["qid", "q"]):
        x, alive = {j: np.full(len(t), 100.0) for j in range(3)}, np.ones(len(t), bool)
        for j, k in stages:
            new = t[f"d{j}"].to_numpy()
            x[j] = np.where(alive, new, 1.2 * new[alive].max())
            x = {i: v / v.mean() if v.mean() else v for i, v in x.items()}
            s = np.exp(-sum(w * x[i] for i, w in enumerate(weights)))
            best = sorted(np.flatnonzero(alive), key=lambda i: (-s[i], -t.idx.iloc[i]))[:k]
            alive = np.isin(np.arange(len(t)), best)
        for i, v in zip(t.idx, s if t.sign.iloc[0] > 0 else 1 - s, strict=True):
            want[qid, i] = want.get((qid, i), 0) + v
    assert got == pytest.approx(want, abs=1e-9)


def test_moments_and_singular_values(spark, sf):
    o = objects(spark, sf)
    x = np.array(o.orderBy("idx").select("v").toPandas().v.tolist())
    n, mean, cov = C.covariance(o, "v")
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    values, axes = C.svd(o, "v", 5)
    assert np.allclose(values, np.linalg.svd(x)[1][:5]) and np.allclose(np.abs(axes @ np.linalg.svd(x)[2][:5].T), np.eye(5), atol=1e-6)


def test_density_clusters_of_a_long_chain(spark):
    """A chain of 300 points, far more than fifty rounds of single steps, is one cluster."""
    rows = [(i, [0.1 * i, 0.0]) for i in range(300)] + [(1000, [500.0, 0.0])]
    got = {r["idx"]: r["cluster"] for r in C.dbscan(spark.createDataFrame(rows, "idx long, v array<double>"), "v", 0.0121, 2).collect()}
    assert {got[i] for i in range(300)} == {0} and got[1000] is None


def test_overlap_by_brute_force(spark, sf):
    from lodestar.plans import registry

    parts = pd.read_parquet(f"{sf}/part.parquet")
    sets = {k: set(n.split(" ")) for k, n in zip(parts.p_partkey, parts.p_name, strict=True)}
    assert {tuple(r) for r in registry.queries()["gt_overlap"](spark, sf).collect()} == {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]}
