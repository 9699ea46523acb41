import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from loglattice.operators import clustering as cl
from loglattice.operators import mixture as mx
from loglattice.operators import selection as sel
from loglattice.sources import tables


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        c = i % 3
        x = [rng.gauss((0, 6, 12)[c], 0.5), rng.gauss((0, 5, -5)[c], 0.5)]
        rows.append((i, c, x, x[0], x[1], rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "row_id long, truth int, x array<double>, a double, b double, noise double")
    return cl.with_vector(df, "x").persist()


def pure(labels, truth):
    pairs = {(r.label, r.truth) for r in labels.join(truth, "row_id").collect()}
    return len(pairs) == 3


def test_split(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    train, test = cl.train_test(df.repartition(7))
    again = {r.row_id for r in cl.train_test(df.repartition(2))[1].collect()}
    assert {r.row_id for r in test.collect()} == again
    assert train.count() + len(again) == 5000 and 400 < len(again) < 600


def test_kmeans_sweep(spark, blobs, tmp_path):
    models = cl.kmeans_sweep(blobs, range(2, 5))
    labels = cl.predict(blobs, models)
    sizes = cl.label_sizes(labels, range(2, 5)).collect()
    assert len(sizes) == 9 and all(sum(r.n for r in sizes if r.k == k) == 300 for k in (2, 3, 4))
    assert pure(labels.where("k = 3"), blobs)
    assert pure(cl.fit_predict(blobs, [3]), blobs)
    tables.store_model(spark, models[3], str(tmp_path), "km_3")
    with pytest.raises(Exception, match="exist"):
        tables.store_model(spark, models[3], str(tmp_path), "km_3")
    loaded = tables.load_model(spark, KMeansModel, str(tmp_path), "km_3")
    assert cl.predict(blobs, {3: loaded}).exceptAll(labels.where("k = 3")).count() == 0
    centers = cl.centers_of(models[3], blobs)
    near = cl.nearest_center(blobs, centers).join(labels.where("k = 3").withColumnRenamed("label", "l"), "row_id")
    assert near.where("label <> l").count() == 0
    distances = cl.center_distances(blobs, centers)
    assert distances.count() == 900
    row = distances.where("row_id = 0").orderBy("center").collect()
    x = np.array(blobs.where("row_id = 0").first().x)
    assert [r.distance for r in row] == pytest.approx([float(np.linalg.norm(x - c)) for c in models[3].clusterCenters()])


@pytest.mark.parametrize("ks", [[3], [2, 3]])
def test_kmeans_is_given_a_table_that_spark_may_cache_as_vectors(monkeypatch, blobs, ks):
    """from a cached table every iteration decodes all rows again."""
    cached, fit = [], cl.KMeans.fit
    monkeypatch.setattr(cl.KMeans, "fit", lambda self, data: cached.append(data.is_cached or data.storageLevel.useMemory) or fit(self, data))
    models = cl.kmeans_sweep(blobs.select("row_id", "features"), ks)
    assert list(models) == ks and cached == [False] * len(ks)


@pytest.mark.parametrize("covariance", ["diag", "full"])
def test_gmm(blobs, covariance):
    models = cl.gmm_sweep(blobs, [2, 3], covariance=covariance, seed=1)
    assert models[2].k == 2
    assert pure(cl.predict(blobs, models).where("k = 3"), blobs)
    assert models[3].weights == pytest.approx([1 / 3] * 3, abs=0.02)


def test_scatter_golden(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (10.0, 1), (11.0, 1)], "a double, label int")
    assert sel.scatter_criterion(df, ["a"]) == pytest.approx(50)
    lone = spark.createDataFrame([(0.0, 0), (1.0, 0), (9.0, 1)], "a double, label int")
    assert np.isfinite(sel.scatter_criterion(lone, ["a"]))
    flat = df.withColumn("b", F.col("a"))
    assert np.isfinite(sel.scatter_criterion(flat, ["a", "b"]))


def test_scatter_two_columns(blobs):
    got = sel.scatter_criterion(blobs, ["a", "b"], "truth")
    rows = blobs.select("a", "b", "truth").collect()
    x, t = np.array([[r.a, r.b] for r in rows]), np.array([r.truth for r in rows])
    sw = sum((t == k).mean() * np.cov(x[t == k], rowvar=False) for k in range(3))
    off = [x[t == k].mean(axis=0) - x.mean(axis=0) for k in range(3)]
    sb = sum((t == k).mean() * np.outer(off[k], off[k]) for k in range(3))
    assert got == pytest.approx(np.trace(np.linalg.inv(sw) @ sb))


def test_scatter_of_large_values(spark):
    rows = [(1e9 + i % 7 * 0.001 + (i % 2) * 0.002, i % 2) for i in range(100)]
    small = [(x - 1e9, k) for x, k in rows]
    near, far = (sel.scatter_criterion(spark.createDataFrame(r, "a double, label int"), ["a"]) for r in (small, rows))
    assert far == pytest.approx(near, rel=1e-3)


def test_mixture_of_large_values(spark):
    rows = [([1e9 + i % 5 * 0.01], 0) for i in range(200)]
    m, _ = mx.weighted_moments(spark.createDataFrame(rows, "x array<double>, label int"), None, label="label", k=1, target="x", target_d=1)
    assert m.covs[0, 0, 0] == pytest.approx(2e-4, rel=1e-4) and m.means[0, 0] == pytest.approx(1e9 + 0.02)


def test_search_with_a_constant_inside_clusters(spark):
    rng = random.Random(3)
    rows = [(i, float(i % 2), rng.gauss(5 * (i % 2), 0.3)) for i in range(200)]
    found = sel.select_em(spark.createDataFrame(rows, "row_id long, flag double, a double"), ["flag", "a"])
    assert found.clustering.clusters >= 1


def test_merge_series_is_merging_again_and_again():
    rng = np.random.default_rng(5)
    roots = rng.normal(size=(9, 2, 2))
    m = mx.Mixture(rng.dirichlet(np.ones(9)), rng.normal(size=(9, 2)) * 4, roots @ roots.transpose(0, 2, 1) + np.eye(2))
    for got in mx.merge_series(m):
        assert got.means == pytest.approx(m.means) and got.weights == pytest.approx(m.weights) and got.covs == pytest.approx(m.covs)
        m = mx.merge_closest(m) if m.k > 1 else m
    roots = rng.normal(size=(200, 2, 2))
    many = mx.Mixture(np.full(200, 1 / 200), rng.normal(size=(200, 2)), roots @ roots.transpose(0, 2, 1) + np.eye(2))
    assert len(mx.merge_series(many)) == 200


def test_mixture_stored_and_loaded(spark, tmp_path):
    m = mx.Mixture(np.array([0.25, 0.75]), np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([np.eye(2), 2 * np.eye(2)]))
    tables.store_model(spark, m, str(tmp_path), "mixture")
    loaded = tables.load_model(spark, mx.Mixture, str(tmp_path), "mixture")
    assert all((getattr(loaded, f) == getattr(m, f)).all() for f in ("weights", "means", "covs"))


def test_closest_pair_golden():
    m = mx.Mixture(np.ones(3) / 3, np.array([[0.0], [1.0], [10.0]]), np.ones((3, 1, 1)))
    i, j, merged = mx.closest_pair(m)
    assert (i, j) == (0, 1)
    assert (merged.means[0, 0], merged.covs[0, 0, 0]) == (0.5, 1.25)
    after = mx.merge_closest(m)
    assert after.weights == pytest.approx([1 / 3, 2 / 3]) and after.means[:, 0] == pytest.approx([10, 0.5])
    assert sel.max_clusters(1000) == 6 and sel.max_clusters(60000) == 16


def test_likelihood_and_moments(blobs):
    labelled = blobs.withColumnRenamed("truth", "label")
    m, _ = mx.weighted_moments(labelled, None, label="label", k=3, target="x", target_d=2)
    x = np.array([r.x for r in blobs.orderBy("row_id").collect()])
    t = np.arange(300) % 3
    for k in range(3):
        assert m.covs[k] == pytest.approx(np.cov(x[t == k], rowvar=False, bias=True))
    density = np.zeros(300)
    for w, mean, cov in zip(m.weights, m.means, m.covs):
        z = x - mean
        e = np.exp(-0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z))
        density += w * e / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    one = mx.merge_closest(mx.merge_closest(m))
    got = mx.log_likelihoods(blobs, [m, one])
    assert got[0] == pytest.approx(np.log(density).sum()) and got[1] < got[0]
    assert m.parameters() == 3 * 2 + 3 * 3 + 2
    assert one.means[0] == pytest.approx(x.mean(axis=0))
    found = sel.Clustering(("a", "b"), 3, 0.0, m)
    crossed = sel.cross_mixture(blobs, found, ["noise"])
    assert crossed.weights == pytest.approx([1 / 3] * 3, abs=1e-6) and crossed.covs.shape == (3, 1, 1)


def test_searches_pick_the_planted_column(blobs):
    km = sel.select_km(blobs, ["noise", "a"])
    assert km.priority["a"] == 1 and km.steps[0].columns == ("a",)
    em = sel.select_em(blobs, ["noise", "a"], criterion="ML")
    assert em.priority["a"] == 1 and em.clustering.clusters >= 3
    ss = sel.select_em(blobs, ["noise", "a"], criterion="SS")
    assert ss.priority["a"] == 1
    table = sel.priorities(blobs, km).collect()
    assert {r.feature for r in table} == {"noise", "a"}
