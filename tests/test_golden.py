"""Distances against values computed by hand from their formulas, and properties they must have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.functions import scalar as S

A, B = [0.5, 0.3, 0.2, 0.0], [0.1, 0.4, 0.2, 0.3]
GOLDEN = {
    "euclidean": 0.26, "l1": 0.8, "weightedeuclidean": 0.26, "weightedeuclidean:WEIGHT=0.9": 0.196, "chisquare": 0.580952, "histogramintersection": 0.4,
    "jsd": 0.360663, "kld": 0.718414, "reldev": 0.875997, "relbindev": 2.635897, "oneminusfidelity": 0.229983, "sqrtoneminusfidelity": 0.479565,
    "logtwominusfidelity": 0.207000, "arccosfidelity": 0.440495, "sinfidelity": 0.638023, "sinfidelity:COMPAT=yes": 0.479565,
}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def array(x):
    return F.array(*map(F.lit, x))


@pytest.mark.parametrize("spec,expected", GOLDEN.items())
def test_golden_distances(spark, spec, expected):
    assert value(spark, D.distance(spec)(array(A), array(B))) == pytest.approx(expected, abs=2e-6)


@pytest.mark.parametrize("name", ["euclidean", "l1", "chisquare", "jsd", "his", "reldev", "arccosfidelity", "relbindev", "fidelity"])
def test_identity_and_symmetry(spark, name):
    f = D.distance(name)
    assert value(spark, f(array(A), array(A))) == pytest.approx(0, abs=1e-7)
    assert value(spark, f(array(A), array(B))) == pytest.approx(value(spark, f(array(B), array(A))))


def test_zero_vectors_do_not_raise(spark):
    zero = [0.0] * 4
    for name, f in D.REGISTRY.items():
        if name in ("weightedl1", "binary", "binaryfeature", "metafeature", "histpair", "facefeature", "facefeat"):
            continue
        assert not math.isnan(value(spark, f(array(zero), array(zero)))), name


def test_unknown_distances_raise():
    with pytest.raises(ValueError):
        D.distance("nothing")
    with pytest.raises(ValueError):
        D.distance("l1:NOTHING=1")


def test_sparse_distances(spark):
    a, b = F.create_map(F.lit("x"), F.lit(0.5), F.lit("y"), F.lit(0.5)), F.create_map(F.lit("y"), F.lit(1.0))
    assert value(spark, D.sparse_fidelity(a, b)) == pytest.approx(1 - math.sqrt(0.5))
    assert value(spark, D.sparse_jsd(a, a)) == pytest.approx(0)


def test_scalars(spark):
    t = F.lit("A=-1.5e1:B=7:C=word:")
    assert value(spark, S.double_after(t, "A=", 0)) == -15.0
    assert value(spark, S.int_after(t, "B=", 0)) == 7
    assert value(spark, S.int_after(t, "Z=", 3)) == 3
    assert value(spark, S.string_after(t, "C=", "")) == "word"
    assert value(spark, S.suffix(F.lit("a/b.jpg.histo.gz"))) == "histo"
    assert value(spark, S.meta_map(F.lit("a:1,b:2,a:3"))) == {"a": "3", "b": "2"}
    assert value(spark, F.array(*S.rgb_to_hsv(F.lit(0.0), F.lit(1.0), F.lit(0.0)))) == pytest.approx([2 * math.pi / 3, 1, 1])
    assert sum(value(spark, F.array(*S.fuzzy_three(F.lit(0.4))))) == pytest.approx(1)
    assert value(spark, S.position_code([F.lit(0), F.lit(3)])) == "03"


def test_pipeline_golden(spark):
    from lodestar.operators import retrieval as R

    rows = [(0, 1, 0, i, *d) for i, d in enumerate([(0.0, 2.0), (1.0, 0.0), (2.0, 4.0)])]
    dist = spark.createDataFrame(rows, "qid int, sign int, q int, idx int, d0 double, d1 double")
    n = R.normalize(dist)
    assert sorted((r["idx"], r["d0"], r["d1"]) for r in n.collect()) == [(0, 0, 1), (1, 1, 0), (2, 2, 2)]
    s = {r["idx"]: r["s"] for r in R.scored(n, R.linear, [1.0, 0.5]).collect()}
    assert [s[i] for i in range(3)] == pytest.approx([0.606531, 0.367879, 0.049787], abs=1e-6)
    ties = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "qid int, idx int, score double")
    assert [r["idx"] for r in R.top(ties, 2).orderBy("rank").collect()] == [2, 1]
    assert np.isclose(s[0], math.exp(-0.5))
