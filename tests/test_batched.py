"""Fits in shared passes against plain versions, and the searches and mixture steps over many columns."""

import numpy as np
import pandas as pd
import pytest

from loglattice.operators import batched
from loglattice.operators import mixture as mx
from loglattice.operators import selection as sel
from workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """Three groups that only columns 2 and 5 of twelve tell apart."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 12))
    group = r.integers(0, 3, 600)
    x[:, 2] = r.normal(group * 9.0, 0.5)
    x[:, 5] = r.normal((group == 1) * 7.0, 0.6)
    return x, spark.createDataFrame(pd.DataFrame({"row_id": range(600), **{f"c{i}": x[:, i] for i in range(12)}})).repartition(3)


def test_one_pass_serves_all_jobs(table):
    x, df = table
    scans = sel.scans_of(df, [f"c{i}" for i in range(12)])
    mixture = mx.Mixture(np.array([0.3, 0.7]), np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([np.eye(2), 2 * np.eye(2) + 0.3]))
    jobs = [batched.Job((2,), batched.Centres(np.array([[-3.0], [4.0]]))), batched.Job((2, 5), mixture), batched.Job((0, 5), mixture, True)]
    centred = x - x.mean(axis=0)
    for of in (batched.step_sums, batched.label_sums):
        for job, got in zip(jobs, scans.sums(jobs, of)):
            assert np.allclose(got, of(job, centred[:, list(job.columns)]))


def test_fits_reach_a_fixed_point(table):
    x, df = table
    scans = sel.scans_of(df, [f"c{i}" for i in range(12)])
    km = batched.kmeans_fits(scans, [((2, 5), k) for k in (2, 3, 4)], tol=1e-12)
    for job in km:
        label = scans.moved_back(job).label(x[:, [2, 5]])
        assert np.allclose(job.model.points + scans.centre[[2, 5]], [x[label == j][:, [2, 5]].mean(axis=0) for j in range(job.model.k)])
    for diagonal in (True, False):
        (job,) = batched.gmm_fits(scans, [((2, 5), 3)], diagonal=diagonal, tol=1e-9)
        model = scans.moved_back(job)
        assert sorted(np.round(model.means[:, 0])) == [0, 9, 18] and np.allclose(model.weights.sum(), 1)


def test_mixtures_of_a_series_evaluate_shared_components_once():
    """F8: a series of k mixtures has 2 k - 1 components, not k (k + 1) / 2; rows far from a mixture keep their digits."""
    r = np.random.default_rng(4)
    mixtures = mx.merge_series(mx.Mixture(np.full(6, 1 / 6), r.normal(size=(6, 2)) * 5, np.array([np.eye(2) * v for v in (1e-4, 1, 1, 2, 0.5, 1)])))
    x = np.concatenate([r.normal(size=(50, 2)) * 6, mixtures[0].means, [[400.0, -300.0]]])
    job = batched.series((0, 1), mixtures)
    assert job.model.k == 11
    assert np.allclose(batched.series_likelihoods(job, x), [mx._log_sum(m.log_joint(x)).sum() for m in mixtures], rtol=1e-12)
    far = batched.series((0,), [mx.Mixture(np.ones(1), np.array([[c]]), np.eye(1)[None]) for c in (0.0, 90.0)])
    x = np.array([[0.0], [90.0], [1.0]])
    assert np.allclose(batched.series_likelihoods(far, x), [mx._log_sum(mx.Mixture(np.ones(1), np.array([[c]]), np.eye(1)[None]).log_joint(x)).sum() for c in (0.0, 90.0)])


def test_shares_only_choose_the_start(table, monkeypatch):
    """F7, F8: most steps read a share of a large table; the last ones read all rows and end at a fixed point of those."""
    x, df = table
    monkeypatch.setattr(batched, "SHARE_ROWS", 70)
    monkeypatch.setattr(batched, "SAMPLE", 20)
    scans, shares, sums = sel.scans_of(df, [f"c{i}" for i in range(12)]), [], batched.Scans.sums
    monkeypatch.setattr(batched.Scans, "sums", lambda self, jobs, of=batched.step_sums, *, share=1: shares.append(share) or sums(self, jobs, of, share=share))
    (job,) = batched.kmeans_fits(scans, [((2, 5), 3)], tol=1e-12)
    assert set(shares) == {1, 8} and shares == sorted(shares, reverse=True)
    label = scans.moved_back(job).label(x[:, [2, 5]])
    assert np.allclose(job.model.points + scans.centre[[2, 5]], [x[label == j][:, [2, 5]].mean(axis=0) for j in range(3)])


def test_searches_over_many_columns_find_the_planted_ones(table):
    x, df = table
    columns = [f"c{i}" for i in range(12)]
    km = sel.select_km(df, columns)
    assert km.priority["c2"] == 1 and all(p == 0 for c, p in km.priority.items() if c not in ("c2", "c5"))
    em = sel.select_em(df, columns)
    assert em.priority["c2"] + em.priority["c5"] >= 1
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    for found in (km.clustering, sel.select_em(df, columns, criterion="SS").clustering):
        at = [columns.index(c) for c in found.columns]
        label = found.model.label(z[:, at]) if isinstance(found.model, batched.Centres) else found.model.log_joint(z[:, at]).argmax(axis=1)
        assert found.score == pytest.approx(plain_scatter(z[:, at], label), rel=2e-2)


def plain_scatter(x, label):
    inside, between = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
    for k in np.unique(label):
        own = x[label == k]
        off = own.mean(axis=0) - x.mean(axis=0)
        inside += len(own) / len(x) * (np.cov(own.T).reshape(inside.shape) if len(own) > 1 else 0)
        between += len(own) / len(x) * np.outer(off, off)
    return float(np.trace(np.linalg.pinv(inside) @ between))


@pytest.fixture(scope="module")
def embedded(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    return np.stack(rows["embedding"].to_list()).astype(float), rows["label"].to_numpy()


def test_scatter_over_all_coordinates(spark, embedded):
    x, label = embedded
    assert QUERIES["scatter_of_embeddings"](spark, FOLDER).first()["score"] == pytest.approx(plain_scatter(x, label), abs=1e-5)


def _full(x, r):
    n = r.sum(axis=0)
    means = r.T @ x / n[:, None]
    return n / n.sum(), means, np.array([((r[:, [j]] * (x - means[j])).T @ (x - means[j])) / n[j] for j in range(r.shape[1])])


def test_merged_components_over_all_coordinates(spark, embedded):
    x, label = embedded
    w, m, c = _full(x, np.eye(10)[label])
    det = lambda a: np.linalg.slogdet(a)[1]
    best = None
    for j in range(10):
        for i in range(j):
            _, _, both = _full(x[(label == i) | (label == j)], np.ones((((label == i) | (label == j)).sum(), 1)))
            cost = w[i] * (det(both[0]) - det(c[i])) + w[j] * (det(both[0]) - det(c[j]))
            best = min(best or (cost, j, i), (cost, j, i))
    got = QUERIES["merged_components_of_embeddings"](spark, FOLDER).where("component = 8").toPandas()
    own = x[(label == best[1]) | (label == best[2])]
    assert got["weight"].iloc[0] == pytest.approx(len(own) / len(x), abs=1e-6)
    assert np.allclose(got["covariance"], np.cov(own.T, bias=True)[got["i"], got["j"]], atol=1e-5)


def test_cross_projection_over_all_coordinates(spark, embedded):
    x, label = embedded
    start = mx.Mixture(*_full(x[:, :32], np.eye(10)[label]))
    w, m, c = _full(x[:, 32:], mx.responsibilities(start, x[:, :32]))
    got = QUERIES["cross_projected_mixture_of_embeddings"](spark, FOLDER).toPandas()
    at = got["component"], got["i"], got["j"]
    assert np.allclose(got["weight"], w[at[0]], atol=1e-5) and np.allclose(got["mean"], m[at[0], at[1]], atol=1e-5)
    assert np.allclose(got["covariance"], c[at] + 1e-6 * (got["i"] == got["j"]), atol=1e-5)


@pytest.mark.parametrize("d", [1, 3, 12])
def test_sums_against_plain_ones(d):
    """Also far from the origin, for centres that coincide, and without work in proportion to clusters on a line."""
    random = np.random.default_rng(d)
    x = random.normal(size=(300, d)) + 1e6
    points = x[[5, 9, 9, 30]]
    far = ((x[:, None, :] - points) ** 2).sum(axis=2)
    near = batched.Centres(points - 1e6)
    label, least = near.nearest(x - 1e6)
    assert 2 not in label and np.allclose(least, far.min(axis=1)) and np.allclose(far[np.arange(300), label], least)
    counts, sums, products = np.split(batched.label_sums(batched.Job(tuple(range(d)), near), x - 1e6), [4, 4 + 4 * d])
    r, y = np.eye(4)[label], x - 1e6
    assert np.allclose(counts, r.sum(axis=0)) and np.allclose(sums, (r.T @ y).ravel())
    assert np.allclose(products, np.einsum("nk,ni,nj->kij", r, y, y).ravel())
    roots = random.normal(size=(3, d, d))
    mixture = mx.Mixture(np.array([0.2, 0.5, 0.3]), x[:3], roots @ roots.transpose(0, 2, 1) + np.eye(d))
    joint = mixture.log_joint(x)
    for j in range(3):
        off = x - mixture.means[j]
        form = np.einsum("ni,ij,nj->n", off, np.linalg.inv(mixture.covs[j]), off)
        assert np.allclose(joint[:, j], np.log(mixture.weights[j]) - 0.5 * (form + np.linalg.slogdet(mixture.covs[j])[1] + d * np.log(2 * np.pi)))
    if d == 1:
        many = batched.Centres(np.linspace(-3, 3, 4000)[:, None])
        assert np.abs(many.points[many.label(y), 0] - y[:, 0].clip(-3, 3)).max() < 0.001


def test_roots_are_worked_out_once(monkeypatch):
    mixture, calls, root = mx.Mixture(np.ones(2) / 2, np.zeros((2, 3)), np.stack([np.eye(3)] * 2)), [], np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda c: calls.append(1) or root(c))
    for _ in range(5):
        mixture.log_joint(np.ones((4, 3)))
    assert len(calls) == 1
