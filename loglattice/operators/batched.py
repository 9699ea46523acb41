"""Fits of many clusterings at once: every iteration reads the rows once, whatever the number of models.

A job is a subset of the columns and a model of it. One pass over the rows adds up the sufficient statistics of all jobs that
still move (counts, sums, products, likelihoods), task by task in Arrow batches; only those sums reach the
driver, which takes the next step of each job. Jobs start from a fit to a bounded sample, then to growing shares of a large
table, so few passes over all rows are left; those go on until nothing moves, wherever the start was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators import mixture as mx

#: Rows the start of a fit is worked out on (twice that at most).
SAMPLE = 2048
SAMPLE_STEPS = 20
#: The first share of a large table has at least so many rows, each next one is GROWTH times as large; coarser than SHARE_TOL they need not settle.
SHARE_ROWS = 1 << 16
GROWTH = 8
SHARE_TOL = 1e-4
#: Rows of a batch that are worked on at once, more where models are small.
SLICE = 1024
#: Up to so many columns, products of any two are made once a row, for all clusters.
FEW = 8


@dataclass(frozen=True)
class Centres:
    points: np.ndarray  # (k, d)

    @property
    def k(self) -> int:
        return len(self.points)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, of equals the first, and its squared distance."""
        if self.points.shape[1] == 1:
            return self._nearest_on_a_line(x[:, 0])
        squares = x @ self.points.T
        squares *= -2
        squares += np.einsum("ni,ni->n", x, x)[:, None]
        squares += (self.points**2).sum(axis=1)
        np.maximum(squares, 0, out=squares)
        label = squares.argmin(axis=1)
        return label, squares[np.arange(len(x)), label]

    def _nearest_on_a_line(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one column: the place among the middles between neighbouring centres."""
        points, firsts = np.unique(self.points[:, 0], return_index=True)
        place = np.searchsorted((points[1:] + points[:-1]) / 2, x)
        place[np.isnan(x)] = 0
        return firsts[place], (x - points[place]) ** 2

    def label(self, x: np.ndarray) -> np.ndarray:
        return self.nearest(x)[0]


Model = Centres | mx.Mixture


@dataclass(frozen=True)
class Job:
    columns: tuple[int, ...]
    model: Model
    diagonal: bool = False


@dataclass(frozen=True)
class Series(Job):
    """Several mixtures of the same columns: ``model`` has all their components, ``member`` says which are whose."""

    member: np.ndarray | None = None  # (components, mixtures)


def series(columns: Sequence[int], mixtures: Sequence[mx.Mixture]) -> Series:
    every, parts = mx.shared_components(mixtures)
    member = np.zeros((every.k, len(mixtures)))
    for m, own in enumerate(parts):
        member[own, m] = 1
    return Series(tuple(columns), every, member=member)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Products of each two columns of few, for every row."""
    first, second = np.triu_indices(x.shape[1])
    along = np.ascontiguousarray(x.T)
    return (along[first] * along[second]).T


def _whole(upper: np.ndarray, d: int) -> np.ndarray:
    """The matrices of sums over ``_pairs``, one after the other."""
    first, second = np.triu_indices(d)
    out = np.empty((len(upper), d, d))
    out[:, first, second] = out[:, second, first] = upper
    return out.ravel()


def _products(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    if x.shape[1] <= FEW:
        return _whole(r.T @ _pairs(x), x.shape[1])
    return np.concatenate([((r[:, [j]] * x).T @ x).ravel() for j in range(r.shape[1])])


def _grouped(label: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each label."""
    if x.shape[1] <= 2 * FEW:
        return np.stack([np.bincount(label, column, minlength=k) for column in x.T], axis=1) if x.shape[1] else np.zeros((k, 0))
    return np.eye(k)[label].T @ x


def _normed(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each row, and its responsibilities."""
    top = joint.max(axis=1)
    r = np.exp(joint - top[:, None])
    total = r.sum(axis=1)
    return top + np.log(total), r / total[:, None]


def step_sums(job: Job, x: np.ndarray) -> np.ndarray:
    """The sums of one k-means or EM step: cost or likelihood, counts, sums, and for a mixture squares or products."""
    if isinstance(job.model, Centres):
        label, least = job.model.nearest(x)
        k = job.model.k
        return np.concatenate([[least.sum()], np.bincount(label, minlength=k), _grouped(label, x, k).ravel()])
    norm, r = _normed(job.model.log_joint(x))
    second = (r.T @ (x * x)).ravel() if job.diagonal else _products(r, x)
    return np.concatenate([[norm.sum()], r.sum(axis=0), (r.T @ x).ravel(), second])


def label_sums(job: Job, x: np.ndarray) -> np.ndarray:
    """Counts, sums and products per label, for the scatter."""
    label = job.model.label(x) if isinstance(job.model, Centres) else job.model.log_joint(x).argmax(axis=1)
    k, d = job.model.k, x.shape[1]
    if d <= FEW:
        second = _whole(_grouped(label, _pairs(x), k), d)
    else:
        second = np.concatenate([(own.T @ own).ravel() for own in (x[label == j] for j in range(k))])
    return np.concatenate([np.bincount(label, minlength=k), _grouped(label, x, k).ravel(), second])


def series_likelihoods(job: Series, x: np.ndarray) -> np.ndarray:
    """The log-likelihood of each mixture of a series; every component is evaluated once a row."""
    joint = job.model.log_joint(x)
    top = joint.max(axis=1)
    whole = np.exp(joint - top[:, None]) @ job.member
    with np.errstate(divide="ignore"):
        out = np.log(whole) + top[:, None]
    # Far below the likeliest component of all mixtures there are no digits left: those are added up around their own.
    lost = whole < 1e-280
    for m in np.flatnonzero(lost.any(axis=0)):
        out[lost[:, m], m] = mx._log_sum(joint[lost[:, m]][:, job.member[:, m] > 0])
    return out.sum(axis=0)


def next_model(job: Job, sums: np.ndarray, floor: float = mx.COVARIANCE_FLOOR) -> Model:
    """The model after a step; a centre without rows stays, a component without rows keeps its shape at no weight."""
    k, d = job.model.k, len(job.columns)
    n, sx = sums[1 : 1 + k], sums[1 + k : 1 + k + k * d].reshape(k, d)
    safe = np.maximum(n, 1e-300)[:, None]
    if isinstance(job.model, Centres):
        return Centres(np.where(n[:, None] > 0, sx / safe, job.model.points))
    means, rest = sx / safe, sums[1 + k + k * d :]
    if job.diagonal:
        covs = np.array([np.diag(np.maximum(v, 0) + floor) for v in rest.reshape(k, d) / safe - means**2])
    else:
        covs = rest.reshape(k, d, d) / safe[:, :, None] - means[:, :, None] * means[:, None, :]
        covs = (covs + covs.transpose(0, 2, 1)) / 2 + floor * np.eye(d)
    thin = n < 1e-8
    covs[thin], means[thin] = job.model.covs[thin], job.model.means[thin]
    return mx.Mixture(np.maximum(n, 1e-12) / np.maximum(n, 1e-12).sum(), means, covs)


class Scans:
    """Passes over the array column ``x`` of a stored table; columns are taken relative to ``centre``."""

    def __init__(self, df: DataFrame, d: int, x: str = "x", *, centred: bool = True) -> None:
        self.df, self.d = df.select(F.col(x).cast("array<double>").alias("x")), d
        self.rows = self.df.count()
        self.centre = mx.column_means(self.df, "x", d) if centred else np.zeros(d)
        part = self.df if self.rows <= SAMPLE else self.df.where(F.pmod(F.xxhash64("x", F.lit(1)), F.lit(self.rows)) < SAMPLE)
        self.sample = np.array([r["x"] for r in part.limit(2 * SAMPLE).collect()], float).reshape(-1, d) - self.centre

    def sums(self, jobs: Sequence[Job], of=step_sums, *, share: int = 1) -> list[np.ndarray]:
        """``of`` of every job, added up in one pass over all rows, or over one in ``share`` by their hash."""
        d, centre, jobs = self.d, self.centre, list(jobs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = [None] * len(jobs)
            for batch in batches:
                every = mx.matrix(batch.column(0), d) - centre
                for i, job in enumerate(jobs):
                    own = every[:, list(job.columns)]
                    rows = max(SLICE, mx.CELLS // max(1, job.model.k * own.shape[1]))
                    for at in range(0, len(own), rows):
                        new = of(job, own[at : at + rows])
                        held[i] = new if held[i] is None else held[i] + new
            for i, s in enumerate(held):
                if s is not None:
                    yield pa.RecordBatch.from_pydict({"job": np.full(len(s), i, np.int32), "i": np.arange(len(s), dtype=np.int32), "s": s})

        rows = self.df if share == 1 else self.df.where(F.pmod(F.xxhash64("x", F.lit(2)), F.lit(share)) == 0)
        found = rows.mapInArrow(run, "job int, i int, s double").groupBy("job", "i").agg(F.sum("s").alias("s"))
        out: dict[int, dict[int, float]] = {}
        for r in found.collect():
            out.setdefault(r["job"], {})[r["i"]] = r["s"]
        empty = np.zeros((0, d))
        return [np.array([out[i][j] for j in range(len(out[i]))]) if i in out else of(job, empty[:, list(job.columns)]) for i, job in enumerate(jobs)]

    def fit(self, jobs: Sequence[Job], *, max_iter: int = 100, tol: float = 1e-3) -> list[Job]:
        """Steps of all jobs until each moves no more: the likelihood or cost of a row changes by less than ``tol`` (of itself for a cost)."""
        jobs = [self._settled_on_sample(j) for j in jobs]
        share = 1
        while self.rows >= share * GROWTH * SHARE_ROWS:
            share *= GROWTH
        while share > 1:
            jobs = self._moved(jobs, max_iter, max(tol, SHARE_TOL), share)
            share //= GROWTH
        return self._moved(jobs, max_iter, tol)

    def _moved(self, jobs: list[Job], max_iter: int, tol: float, share: int = 1) -> list[Job]:
        jobs = list(jobs)
        last = [math.inf] * len(jobs)
        moving = list(range(len(jobs)))
        for _ in range(max_iter):
            if not moving or not self.rows:
                break
            sums = self.sums([jobs[i] for i in moving], share=share)
            still = []
            for i, s in zip(moving, sums, strict=True):
                now = s[0] / (self.rows if share == 1 else max(s[1 : 1 + jobs[i].model.k].sum(), 1))
                scale = max(abs(now), 1e-12) if isinstance(jobs[i].model, Centres) else 1.0
                done = abs(now - last[i]) < tol * scale
                last[i] = now
                if not done:
                    jobs[i] = Job(jobs[i].columns, next_model(jobs[i], s), jobs[i].diagonal)
                    still.append(i)
            moving = still
        return jobs

    def _settled_on_sample(self, job: Job) -> Job:
        x = self.sample[:, list(job.columns)]
        for _ in range(SAMPLE_STEPS if len(x) else 0):
            job = Job(job.columns, next_model(job, step_sums(job, x)), job.diagonal)
        return job

    def start(self, columns: Sequence[int], k: int, seed: int = 0) -> Centres:
        """Centres spread over the sample, each new one chosen by its squared distance to those before."""
        x, random = self.sample[:, list(columns)], np.random.default_rng([seed, k, *columns])
        if not len(x):
            return Centres(np.zeros((k, len(columns))))
        points = [x[random.integers(len(x))]]
        far = ((x - points[0]) ** 2).sum(axis=1)
        while len(points) < k:
            total = far.sum()
            points.append(x[random.choice(len(x), p=far / total)] if total > 0 else x[random.integers(len(x))])
            far = np.minimum(far, ((x - points[-1]) ** 2).sum(axis=1))
        return self._settled_on_sample(Job(tuple(columns), Centres(np.array(points)))).model

    def mixture_start(self, columns: Sequence[int], k: int, diagonal: bool, seed: int = 0) -> Job:
        """The moments of the sample's k-means clusters, each with a little of the whole spread."""
        x, centres = self.sample[:, list(columns)], self.start(columns, k, seed)
        d = len(columns)
        whole = np.cov(x.T, bias=True).reshape(d, d) if len(x) > 1 else np.eye(d)
        r = np.eye(k)[centres.label(x)] if len(x) else np.zeros((0, k))
        n = r.sum(axis=0)
        covs = np.empty((k, d, d))
        for j in range(k):
            off = x - centres.points[j]
            covs[j] = ((r[:, [j]] * off).T @ off + d * whole) / (n[j] + d)
        covs = np.array([np.diag(np.diagonal(c)) for c in covs]) if diagonal else covs
        covs = covs + mx.COVARIANCE_FLOOR * np.eye(d)
        return Job(tuple(columns), mx.Mixture((n + 1) / (n + 1).sum(), centres.points, covs), diagonal)

    def moved_back(self, job: Job) -> Model:
        """The model in the coordinates of the table."""
        shift = self.centre[list(job.columns)]
        if isinstance(job.model, Centres):
            return Centres(job.model.points + shift)
        return mx.Mixture(job.model.weights, job.model.means + shift, job.model.covs)


def gmm_fits(scans: Scans, subsets: Sequence[tuple[Sequence[int], int]], *, diagonal: bool, seed: int = 0, max_iter: int = 100, tol: float = 1e-3) -> list[Job]:
    """A mixture for each (columns, k), all from shared passes."""
    return scans.fit([scans.mixture_start(c, k, diagonal, seed) for c, k in subsets], max_iter=max_iter, tol=tol)


def kmeans_fits(scans: Scans, subsets: Sequence[tuple[Sequence[int], int]], *, seed: int = 0, max_iter: int = 100, tol: float = 1e-4) -> list[Job]:
    return scans.fit([Job(tuple(c), scans.start(c, k, seed)) for c, k in subsets], max_iter=max_iter, tol=tol)
