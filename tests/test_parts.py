"""Images, matching, models, formats, sessions and streams against independent computations."""

import gzip
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import imaging as I
from lodestar.operators import clustering as C
from lodestar.operators import rerank as RR
from lodestar.plans.fixtures import objects
from lodestar.plans.session import Session
from lodestar.sources import formats as T

rng = np.random.default_rng(1)


def test_convolutions_agree():
    image, kernel = rng.random((9, 7)), rng.random((3, 3))
    assert np.allclose(I.convolve(image, kernel), I.fft_convolve(image, kernel))
    assert I.convolve(image, kernel)[4, 3] == pytest.approx((image[3:6, 2:5] * kernel).sum())


def test_transforms_invert():
    image = rng.random((8, 6))
    assert np.allclose(I.inverse_dct(I.dct(image)), image)
    assert np.allclose(I.scale(image, 8, 6), image)
    assert np.allclose(I.fft_scale(image, 8, 6), image)
    assert np.allclose(I.affine(image, np.eye(2), [0, 0]), image)
    assert np.allclose(I.rotate90(I.rotate90(I.rotate90(I.rotate90(image)))), image)


def test_box_mean_clips():
    image = rng.random((5, 5))
    assert I.box_mean(image, 1)[0, 0] == pytest.approx(image[:2, :2].mean())
    assert np.allclose(I.local_variance(np.ones((4, 4))), 0)


def test_assignment_and_cover_are_least():
    cost = rng.random((4, 5))
    best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
    assert sum(cost[i, j] for i, j in I.assignment(cost)) == pytest.approx(best)
    a, b = rng.random((3, 2)), rng.random((3, 2))
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    edges = list(itertools.product(range(3), range(3)))
    least = min(sum(d[e] for e in s) for n in range(3, 7) for s in itertools.combinations(edges, n) if {e[0] for e in s} == {0, 1, 2} == {e[1] for e in s})
    assert I.edge_cover(a, b) == pytest.approx(least)


def test_earth_mover():
    a, b = np.array([[0.0], [1.0]]), np.array([[0.0], [2.0]])
    assert I.earth_mover(a, np.array([1, 1]), a, np.array([2, 2])) == pytest.approx(0)
    assert I.earth_mover(a, np.array([1, 1]), b, np.array([1, 1])) == pytest.approx(0.5)
    assert I.earth_mover(np.empty((0, 1)), np.empty(0), b, np.array([1, 1])) == 2.0


def test_matching_of_equal_images():
    image = rng.random((8, 8))
    assert I.image_distortion(image, image) == 0
    assert I.cross_correlation(image, image) == pytest.approx(0)
    assert I.tamura(image, 4).sum() == 64
    assert len(I.gabor(image)) == 24
    assert I.invariant(image).sum() == 64
    assert np.linalg.norm(I.orientation_descriptor(rng.random((20, 20)), 10, 10)) == pytest.approx(1)


def test_dog_finds_a_blob():
    y, x = np.indices((41, 41))
    blob = np.exp(-((y - 20) ** 2 + (x - 20) ** 2) / (2 * 1.5**2))
    assert (20, 20) in [(p[0], p[1]) for p in I.dog_points(blob, 5)]


def test_pca_matches_numpy(spark, sf):
    o = objects(spark, sf)
    v = np.array([r["v"] for r in o.select("v").collect()])
    mean, axes, values = C.pca(o, "v", 3)
    assert np.allclose(mean, v.mean(0))
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(v.T, bias=True)))[::-1][:3])
    p = np.array(o.where("idx = 0").select(C.project(F.col("v"), mean, axes)).head()[0])
    assert np.allclose(p, axes @ (v[0] - mean))


def test_splitting_lowers_distortion(spark):
    points = [(float(x + i % 3 * 0.01), float(y)) for i, (x, y) in enumerate([(0, 0), (5, 5), (0, 5), (5, 0)] * 10)]
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "idx long, v array<double>")
    n, mean, var = C.fit_splitting(df, "v", 2, 4)
    assert sorted(n.tolist()) == [10, 10, 10, 10] and var.max() < 0.1
    assert T.parse_cluster_model(T.write_cluster_model(n, mean, var)) == (n.astype(int).tolist(), mean.tolist(), var.tolist())


def test_dbscan(spark):
    rows = [(i, [float(i // 5) * 10 + 0.1 * (i % 5), 0.0]) for i in range(10)] + [(99, [50.0, 50.0])]
    out = {r["idx"]: r["cluster"] for r in C.dbscan(spark.createDataFrame(rows, "idx long, v array<double>"), "v", 0.04, 2).collect()}
    assert out == {**{i: 0 for i in range(5)}, **{i: 5 for i in range(5, 10)}, 99: None}


def test_feedback_learns_the_useful_dimension():
    pos, neg = np.array([[0.0, 0.0], [0.0, 1.0], [0.1, 0.5]]), np.array([[1.0, 0.1], [1.0, 0.9]])
    for tune in (RR.tune_weighted_l1, RR.tune_dimension_weights):
        w = tune(pos, neg)
        assert w[0] > w[1]
    assert RR.tune_weighted_l1(pos[:1], neg).tolist() == [1, 1]


def test_rerank_orders():
    scores, v = np.array([0.9, 0.89, 0.5]), np.array([[0.0], [0.0], [1.0]])
    assert RR.greedy_order(scores, v, 0.2, 3)[:2] == [0, 2]
    assert sorted(RR.sequence_order(scores, v, 3, 1.0)) == [0, 1, 2]


VECTOR = "# v\ndim 3\ndata 1 2 3.5\n"
SPARSE = "dim 2\ncounter 3\nsteps 4 4\nmin 0 0\nmax 1 1\nbins 2\ndata 01 2\ndata 13 1\n"


def test_formats(spark, tmp_path):
    (tmp_path / "a.vec").write_text(VECTOR)
    (tmp_path / "b.vec").write_bytes(gzip.compress(VECTOR.encode()))
    rows = T.read_features(spark, f"{tmp_path}/*.vec", "vec").collect()
    assert [r["v"] for r in rows] == [[1, 2, 3.5]] * 2
    assert T.parse_sparse(SPARSE)["bins"] == {"01": 2, "13": 1}
    assert T.parse_local("winsize 2\nfilename x.png\nimagesize 4 5\nfeatures 1\nfeature 1 2 3 .5 .25\n")["lf"][0]["v"] == [0.5, 0.25]
    assert T.parse_meta("a: b\nc: d e")["meta"] == {"a": "b", "c": "d e"}
    assert T.parse_binary("GRAY")["flag"] and not T.parse_binary("0")["flag"]
    with pytest.raises(ValueError):
        T.parse_vector("dim 2\ndata 1")
    listed = T.parse_filelist("# list\nclasses yes\ndescriptions yes\npath /p\nsuffix vec\nfeaturedirectories yes\nfile a 3 red car\nfile b 1\n")
    assert listed.files == [("a", 3, ["red", "car"]), ("b", 1, [])] and listed.feature_path("a", "vec") == "/p/vec/a.vec"
    assert T.parse_querylist("q a b\n+x -y # z\n") == [{"pos": ["q"], "neg": [], "relevant": ["a", "b"]}, {"pos": ["x"], "neg": ["y"], "relevant": ["z"]}]


def test_jf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "class int, v array<double>")
    T.write_jf(df, f"{tmp_path}/jf")
    assert sorted(map(tuple, T.read_jf(spark, f"{tmp_path}/jf").select("class", F.array_join(F.col("v").cast("array<string>"), ",")).collect())) == [(0, "1.0,2.0"), (1, "3.0,4.5")]
    T.write_arff(df, f"{tmp_path}/arff")
    assert spark.read.text(f"{tmp_path}/arff").count() == 7  # relation, two numbers, class, data, two rows
    (tmp_path / "d").write_text("# c\nnofdistances 2 2\n0 .5 1\n1 0 2\n")
    assert {r["idx"]: r["d"] for r in T.read_distances(spark, f"{tmp_path}/d").collect()} == {0: [0.5, 1.0], 1: [0.0, 2.0]}


def test_session(spark, sf, tmp_path):
    s = Session(objects(spark, sf), [("v", "euclidean"), ("h", "jsd")])
    out = s.batch(["# comment", "setresults 5", "setweight 1 0.5", "retrieve +o0 o1 -o2", "expand 1 o0", "class o3", "info", "interactor ACTION=min(0,1)", "setdist 0 l1", "setfilter 0:100-1:20", "retrieve o0"])
    assert out[0] == out[1] == "ok" and out[2].count() == 5 and [r["rank"] for r in out[3].collect()] == [6, 7, 8, 9, 10]
    assert out[5]["size"] == 500 and out[9].head()["name"] == "o0"
    assert s.command(f"savedistances o0 {tmp_path}/dist") == "ok"
    with pytest.raises(Exception):
        s.command(f"savedistances o0 {tmp_path}/dist")
    with pytest.raises(ValueError):
        s.command("nonsense")


def test_streams(spark, sf, tmp_path):
    from lodestar.streaming import ingest as G

    source = objects(spark, sf).select("idx", "name", "class", "v", "h").where("idx < 20")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    G.ingest_objects(stream, f"{tmp_path}/objects", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/objects").count() == 20
    G.score_stream(stream.select("idx"), lambda b: b.join(source, "idx").select("idx", "class"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events")
    q = G.event_histograms(events).writeStream.format("memory").queryName("histograms").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM histograms").head()[0] == 1000


def test_porter_stems():
    from lodestar.functions.stemming import stem

    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file",
             "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control", "rate": "rate"}
    assert {w: stem(w) for w in known} == known


def test_classifiers_and_splits(spark):
    rows = [(i, i % 2, [float(i % 2) * 4 + 0.01 * i, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, class int, v array<double>")
    out = C.classify_gaussian(df, "v", C.class_gaussians(df, "v", "class"))
    assert out.where("prediction <> class").count() == 0
    a, b = C.split(df, "idx", 0.5)
    assert a.count() + b.count() == 60 and a.join(b, "idx").count() == 0
    points = spark.createDataFrame([(0, float(x), 0.1 * x) for x in (0, 1, 2, 50, 51, 52)], "idx long, x double, y double")
    assert sorted(r["count"] for r in C.position_clusters(points, "idx", 1).collect()) == [3, 3]
    assert sum(r["count"] for r in C.signatures(df, "class", "v").collect()) == 60


def test_reconstruction_map():
    image = rng.random((12, 12))
    image[4:7, 5:8] = 0.5
    m = C.reconstruction_map(image, np.full(9, 0.5), np.zeros((0, 9)), 3, 3)
    assert m[4, 5] == 0 and m.max() == 1
