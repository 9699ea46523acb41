"""Feature selection without labels: greedy forward search over clusterings.

The driver owns the search. All candidates of a step are fitted together, in passes over one stored table
of standardised columns that serve every candidate and every number of clusters; only moments and model parameters
come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators import batched
from loglattice.operators import mixture as mx
from loglattice.operators.scaling import z_score

Score = Callable[[DataFrame], float]


def max_clusters(rows: int) -> int:
    """Largest number of clusters tried: the fourth root of the row count, plus one."""
    return int(rows**0.25) + 1


@dataclass(frozen=True)
class Moments:
    n: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    covs: np.ndarray  # (k, d, d), divided by n - 1


def cluster_moments(
    df: DataFrame, columns: Sequence[str], label: str = "label", centre: Sequence[float] | None = None
) -> DataFrame:
    """``(label, i, j, s)``: per cluster the row count (i = j = -1), the sums (j = -1) and the sums of products (i <= j).

    Columns are numbered and taken relative to ``centre`` (default 0). Arrow batches are added up inside each
    task, so a task hands on k d^2 / 2 numbers whatever its rows.
    """
    d = len(columns)
    low = np.zeros(d) if centre is None else np.asarray(centre, dtype=float)
    first, second = np.triu_indices(d)
    at_i = np.concatenate([[-1], np.arange(d), first]).astype(np.int32)
    at_j = np.concatenate([[-1], np.full(d, -1), second]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            labels, x = batch.column(0).to_numpy(zero_copy_only=False), mx.matrix(batch.column(1), d) - low
            for k in np.unique(labels).tolist():
                own = x[labels == k]
                sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[first, second]])
                held[k] = held.get(k, 0) + sums
        for k, sums in held.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(sums), pa.int64()), "i": at_i, "j": at_j, "s": sums})

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("label"), _array(columns).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "label long, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s"))


def read_moments(table: DataFrame, d: int) -> Moments:
    """Moments on the driver: k d^2 / 2 numbers; means are relative to the centre of ``table``."""
    rows = table.collect()
    place = {k: n for n, k in enumerate(sorted({r["label"] for r in rows}))}
    n, sx, sxx = np.zeros(len(place)), np.zeros((len(place), d)), np.zeros((len(place), d, d))
    for r in rows:
        k, i, j = place[r["label"]], r["i"], r["j"]
        if i < 0:
            n[k] = r["s"]
        elif j < 0:
            sx[k, i] = r["s"]
        else:
            sxx[k, i, j] = sxx[k, j, i] = r["s"]
    means = sx / n[:, None]
    centred = sxx - n[:, None, None] * means[:, :, None] * means[:, None, :]
    return Moments(n, means, centred / np.maximum(n - 1, 1)[:, None, None])


def scatter(moments: Moments) -> float:
    """trace(Sw^-1 Sb): spread between the clusters over the spread inside them.

    A cluster of one row adds nothing to Sw; a singular Sw is inverted on its range.
    """
    share = moments.n / moments.n.sum()
    inside = np.einsum("k,kij->ij", share * (moments.n > 1), moments.covs)
    off = moments.means - share @ moments.means
    between = np.einsum("k,ki,kj->ij", share, off, off)
    if np.linalg.matrix_rank(inside, hermitian=True) < len(inside):
        return float(np.trace(np.linalg.pinv(inside, hermitian=True) @ between))
    return float(np.trace(np.linalg.solve(inside, between)))


def scatter_criterion(df: DataFrame, columns: Sequence[str], label: str = "label") -> float:
    """``scatter`` of the labels; sums are taken around the means of the columns, so large values lose no digits."""
    centre = [v or 0.0 for v in df.agg(*[F.avg(c) for c in columns]).first()]
    return scatter(read_moments(cluster_moments(df, columns, label, centre), len(columns)))


def _array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c) for c in columns])


@dataclass(frozen=True)
class Clustering:
    """A clustering of some columns: ``labelled(df)`` adds its ``label`` to any table of them."""

    columns: tuple[str, ...]
    clusters: int
    score: float
    model: Any = field(repr=False, default=None)

    def labelled(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, mx.Mixture):
            return mx.assign(df.withColumn("__x", _array(self.columns)), self.model, "__x").drop("__x")
        if isinstance(self.model, batched.Centres):
            centres, d = self.model, len(self.columns)

            @F.pandas_udf("int")
            def nearest(x):
                return pd.Series(centres.label(np.vstack(x.to_numpy()).reshape(-1, d)).astype("int32") if len(x) else [], dtype="int32")

            return df.withColumn("label", nearest(_array(self.columns).cast("array<double>")))
        return df.withColumn("label", F.lit(0))


def scans_of(df: DataFrame, columns: Sequence[str]) -> batched.Scans:
    """Passes over all ``columns``; a subset of them is a choice of places."""
    return batched.Scans(df.select(_array(columns).cast("array<double>").alias("x")), len(columns))


def _moments(job: batched.Job, sums: np.ndarray) -> Moments:
    """Moments of the labels that have rows."""
    k, d = job.model.k, len(job.columns)
    n, sx, sxx = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d :].reshape(k, d, d)
    some = n > 0
    n, sx, sxx = n[some], sx[some], sxx[some]
    means = sx / n[:, None]
    return Moments(n, means, (sxx - n[:, None, None] * means[:, :, None] * means[:, None, :]) / np.maximum(n - 1, 1)[:, None, None])


def _scatters(scans: batched.Scans, jobs: Sequence[batched.Job]) -> list[float]:
    return [scatter(_moments(j, s)) if (s[: j.model.k] > 0).sum() > 1 else 0.0 for j, s in zip(jobs, scans.sums(jobs, batched.label_sums))] if jobs else []


def em_clusterings(scans: batched.Scans, names: Sequence[str], subsets: Sequence[Sequence[str]], *, criterion: str = "ML", seed: int = 0) -> list[Clustering]:
    """Gaussian mixtures of several subsets of the columns ``names``, each with its number of components chosen by merging.

    One fit with the largest number, then the closest pair is merged again and again without
    fitting; all those mixtures of all subsets are scored in one pass and the best (of equals the smallest)
    is kept. ``criterion`` ML scores by likelihood, SS by scatter.
    """
    places = [[list(names).index(c) for c in subset] for subset in subsets]
    fits = batched.gmm_fits(scans, [(p, max_clusters(scans.rows)) for p in places], diagonal=False, seed=seed)
    series = [mx.merge_series(f.model) for f in fits]
    totals = scans.sums([batched.series(f.columns, ms) for f, ms in zip(fits, series)], batched.series_likelihoods)
    chosen = []
    for f, ms, total in zip(fits, series, totals):
        scores = [mx.criterion(float(t), m, scans.rows) for t, m in zip(total, ms)]
        best = max(range(len(ms)), key=lambda i: (scores[i], i))
        chosen.append((batched.Job(f.columns, ms[best]), scores[best]))
    if criterion == "SS":
        chosen = list(zip([j for j, _ in chosen], _scatters(scans, [j for j, _ in chosen])))
    return [Clustering(tuple(s), j.model.k, score, scans.moved_back(j)) for s, (j, score) in zip(subsets, chosen)]


def km_clusterings(scans: batched.Scans, names: Sequence[str], subsets: Sequence[Sequence[str]], *, seed: int = 0) -> list[Clustering]:
    """K-means of several subsets for every k up to the largest, in shared passes; best scatter, of equals the smallest k."""
    places = [[list(names).index(c) for c in subset] for subset in subsets]
    ks = range(2, max_clusters(scans.rows) + 1)
    jobs = batched.kmeans_fits(scans, [(p, k) for p in places for k in ks], seed=seed)
    scores = iter(zip(jobs, _scatters(scans, jobs)))
    out = []
    for subset in subsets:
        tried = [Clustering(tuple(subset), 1, 0.0)]
        for k in ks:
            job, score = next(scores)
            tried.append(Clustering(tuple(subset), k, score, scans.moved_back(job)))
        out.append(max(tried, key=lambda t: t.score))
    return out


def em_clustering(df: DataFrame, columns: Sequence[str], *, criterion: str = "ML", seed: int = 0) -> Clustering:
    """``em_clusterings`` of all ``columns``."""
    return em_clusterings(scans_of(df, columns), columns, [columns], criterion=criterion, seed=seed)[0]


def km_clustering(df: DataFrame, columns: Sequence[str], *, seed: int = 0) -> Clustering:
    """``km_clusterings`` of all ``columns``."""
    return km_clusterings(scans_of(df, columns), columns, [columns], seed=seed)[0]


Clusterer = Callable[[Sequence[Sequence[str]]], list[Clustering]]


def forward_step(columns: Sequence[str], chosen: Sequence[str], cluster: Clusterer) -> Clustering:
    """The best clustering of ``chosen`` plus one more column, all tried together; of equals the first column."""
    tried = cluster([_ordered(columns, [*chosen, c]) for c in columns if c not in chosen])
    return max(tried, key=lambda t: t.score)  # max keeps the first of equals


def _ordered(columns: Sequence[str], subset: Sequence[str]) -> list[str]:
    return [c for c in columns if c in subset]


@dataclass(frozen=True)
class Selection:
    """Outcome of a search: ``priority`` of each column (0: not chosen) and its clustering."""

    priority: dict[str, int]
    clustering: Clustering
    steps: tuple[Clustering, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.clustering.columns


def cross_mixture(df: DataFrame, found: Clustering, columns: Sequence[str]) -> mx.Mixture:
    """The clustering of ``found`` seen in other columns: responsibilities there, moments here."""
    data = df.select(_array(found.columns).alias("x"), _array(columns).alias("y"))
    options = dict(target="y", target_d=len(columns), floor=mx.COVARIANCE_FLOOR)
    projected, _ = mx.weighted_moments(data, found.model, "x", **options)
    return projected


def _cross_likelihood(df: DataFrame, rows: int, found: Clustering, columns: Sequence[str]) -> float:
    projected = cross_mixture(df, found, columns)
    data = df.select(_array(columns).alias("x"))
    return mx.criterion(mx.log_likelihoods(data, [projected])[0], projected, rows)


def _search(
    columns: Sequence[str],
    cluster: Clusterer,
    cross: Callable[[Clustering, Sequence[str]], float],
) -> Selection:
    """Grow the subset while the new one wins the comparison across subsets.

    Each clustering is also scored in the other's columns; the new one wins when
    score(S1, C1) * score(S2, C1) exceeds score(S2, C2) * score(S1, C2).
    """
    steps: list[Clustering] = []
    added: list[str] = []
    kept = 0
    while len(added) < len(columns):
        new = forward_step(columns, added, cluster)
        added += [c for c in new.columns if c not in added]
        steps.append(new)
        if len(steps) > 1:
            old = steps[-2]
            if not new.score * cross(new, old.columns) - old.score * cross(old, new.columns) > 0:
                break
        kept = len(steps)
    priority = {c: added.index(c) + 1 if c in added[:kept] else 0 for c in columns}
    return Selection(priority, steps[kept - 1], tuple(steps))


def select_em(df: DataFrame, columns: Sequence[str], *, criterion: str = "ML", seed: int = 0) -> Selection:
    """Forward selection with mixture clustering, scored by ``ML`` or ``SS``."""
    data = z_score(df, columns).select(*columns).persist()
    try:
        scans = scans_of(data, columns)

        def cross(found: Clustering, other: Sequence[str]) -> float:
            if criterion == "SS":
                return scatter_criterion(found.labelled(data), other)
            return _cross_likelihood(data, scans.rows, found, other)

        return _search(columns, lambda subsets: em_clusterings(scans, columns, subsets, criterion=criterion, seed=seed), cross)
    finally:
        data.unpersist()


def select_km(df: DataFrame, columns: Sequence[str], *, seed: int = 0) -> Selection:
    """Forward selection with k-means clustering, scored by scatter."""
    data = z_score(df, columns).select(*columns).persist()
    try:
        scans = scans_of(data, columns)
        return _search(
            columns,
            lambda subsets: km_clusterings(scans, columns, subsets, seed=seed),
            lambda found, other: scatter_criterion(found.labelled(data), other),
        )
    finally:
        data.unpersist()


def priorities(df: DataFrame, found: Selection) -> DataFrame:
    """``(feature, priority, clusters, score)``: the search result as a table."""
    rows = [(c, p, found.clustering.clusters, float(found.clustering.score)) for c, p in found.priority.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, priority int, clusters int, score double")
