"""Gaussian mixtures from given parameters: scoring, assignment and weighted moments.

A fitted mixture is a small driver value (k weights, means, covariances). Passes over the
rows run in Arrow batches and return sums, which Spark adds up; rows never leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the amount added to covariance diagonals when a mixture is estimated.
COVARIANCE_FLOOR = 1e-6
# Numbers worked on at once.
CELLS = 1 << 15


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    covs: np.ndarray  # (k, d, d)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def d(self) -> int:
        return self.means.shape[1]

    @cached_property
    def _whitening(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A point amid the means; inverse roots of the covariances, and the means from there by them; constants."""
        amid = self.means.mean(axis=0)
        roots = np.linalg.cholesky(self.covs)
        inverse = np.linalg.inv(roots)
        with np.errstate(divide="ignore"):
            constant = np.log(self.weights) - np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1) - 0.5 * self.d * math.log(2 * math.pi)
        return amid, inverse, np.einsum("kij,kj->ki", inverse, self.means - amid), constant

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        amid, inverse, shift, constant = self._whitening
        # Rows of ``x`` lie along the last axis, several components form one product.
        out, along = np.empty((self.k, len(x))), np.ascontiguousarray((x - amid).T)
        at_once = max(1, CELLS // max(1, self.d * len(x)))
        for j in range(0, self.k, at_once):
            some = slice(j, j + at_once)
            z = inverse[some].reshape(-1, self.d) @ along
            z -= shift[some].reshape(-1, 1)
            z *= z
            z.reshape(-1, self.d, len(x)).sum(axis=1, out=out[some])
        out *= -0.5
        out += constant[:, None]
        return out.T

    def parameters(self, diagonal: bool = False) -> int:
        """Number of free parameters."""
        per_cov = self.d if diagonal else self.d * (self.d + 1) // 2
        return self.k * (self.d + per_cov) + self.k - 1


def _log_sum(joint: np.ndarray) -> np.ndarray:
    top = joint.max(axis=1)
    return top + np.log(np.exp(joint - top[:, None]).sum(axis=1))


def responsibilities(mixture: Mixture, x: np.ndarray) -> np.ndarray:
    joint = mixture.log_joint(x)
    return np.exp(joint - _log_sum(joint)[:, None])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a two-dimensional array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


def shared_components(mixtures: Sequence[Mixture]) -> tuple[Mixture, list[list[int]]]:
    """The components of all mixtures, those shared with the same weight (as in a ``merge_series``) once, and the places of each mixture's."""
    known: dict[tuple, int] = {}
    single: list[Mixture] = []
    parts: list[list[int]] = []
    for m in mixtures:
        keys = [(float(m.weights[j]), m.means[j].tobytes(), m.covs[j].tobytes()) for j in range(m.k)]
        for j, key in enumerate(keys):
            if key not in known:
                known[key] = len(single)
                single.append(Mixture(m.weights[[j]], m.means[[j]], m.covs[[j]]))
        parts.append([known[key] for key in keys])
    return Mixture(*(np.concatenate([getattr(s, f) for s in single]) for f in ("weights", "means", "covs"))), parts


def log_likelihoods(df: DataFrame, mixtures: Sequence[Mixture], features: str = "x") -> list[float]:
    """Total log-likelihood of the rows under each mixture, all in one pass; a shared component is evaluated once per row."""
    every, parts = shared_components(mixtures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(mixtures))
        for batch in batches:
            if batch.num_rows:
                joint = every.log_joint(matrix(batch.column(0), every.d))
                sums += [_log_sum(joint[:, own]).sum() for own in parts]
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(mixtures), dtype=np.int32), "s": sums})

    rows = df.select(features).mapInArrow(run, "i int, s double")
    found = {r["i"]: r["s"] for r in rows.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return [found[i] for i in range(len(mixtures))]


def criterion(log_likelihood: float, mixture: Mixture, rows: int) -> float:
    """Minus the Bayesian information criterion: higher is better."""
    return 2 * log_likelihood - mixture.parameters() * math.log(rows)


def assign(df: DataFrame, mixture: Mixture, features: str = "x", label: str = "label") -> DataFrame:
    """Add the most probable component of each row."""
    d = mixture.d

    @F.pandas_udf("int")
    def best(x):
        if not len(x):
            return x.astype("int32")
        return _series(mixture.log_joint(np.vstack(x.to_numpy()).reshape(-1, d)).argmax(axis=1))

    return df.withColumn(label, best(F.col(features)))


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values.astype("int32"))


def column_means(df: DataFrame, column: str, d: int) -> np.ndarray:
    """Means of an array column of length ``d``."""
    entry = F.col(column)
    row = df.agg(*[F.avg(entry[i]).alias(f"m{i}") for i in range(d)]).first()
    return np.array([0.0 if v is None else v for v in row], dtype=float)


def weighted_moments(
    df: DataFrame,
    mixture: Mixture | None,
    features: str = "x",
    *,
    target: str | None = None,
    target_d: int | None = None,
    label: str | None = None,
    k: int | None = None,
    diagonal: bool = False,
    floor: float = 0.0,
    centre: np.ndarray | None = None,
) -> tuple[Mixture, float]:
    """Mixture estimated on ``target`` from the responsibilities of ``mixture`` on ``features``.

    With ``label`` instead of a mixture every row belongs to its label. Also returns the
    log-likelihood of the rows under ``mixture`` (0 with labels). Sums are taken around ``centre`` (the mean of
    ``target``, found in a pass of its own if not given), so that large values lose no digits.
    """
    target = target or features
    d_in = mixture.d if mixture is not None else 0
    d = target_d or d_in
    k = mixture.k if mixture is not None else k
    columns = [features if mixture is not None else label, target]
    centre = column_means(df, target, d) if centre is None else centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, total = np.zeros(k), np.zeros((k, d)), 0.0
        sxx = np.zeros((k, d) if diagonal else (k, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch.column(1), d) - centre
            if mixture is None:
                r = np.eye(k)[batch.column(0).to_numpy(zero_copy_only=False)]
            else:
                joint = mixture.log_joint(matrix(batch.column(0), d_in))
                norm = _log_sum(joint)
                r, total = np.exp(joint - norm[:, None]), total + norm.sum()
            n += r.sum(axis=0)
            sx += r.T @ y
            if diagonal:
                sxx += r.T @ (y * y)
            else:
                sxx += np.einsum("nk,ni,nj->kij", r, y, y, optimize=True)
        flat = np.concatenate([[total], n, sx.ravel(), sxx.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "s": flat})

    # Distinct names: Arrow batches keep both even when features and target are one column.
    picked = df.select(F.col(columns[0]).alias("a"), F.col(columns[1]).alias("b"))
    parts = picked.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    size = 1 + k + k * d + (k * d if diagonal else k * d * d)
    flat = np.zeros(size)
    for r in parts.collect():
        flat[r["i"]] = r["s"]
    n = flat[1 : 1 + k]
    sx = flat[1 + k : 1 + k + k * d].reshape(k, d)
    safe = np.maximum(n, 1e-300)
    means = sx / safe[:, None]
    if diagonal:
        spread = flat[1 + k + k * d :].reshape(k, d) / safe[:, None] - means**2
        covs = np.array([np.diag(np.maximum(s, 0) + floor) for s in spread])
    else:
        covs = flat[1 + k + k * d :].reshape(k, d, d) / safe[:, None, None]
        covs = covs - means[:, :, None] * means[:, None, :] + floor * np.eye(d)
    return Mixture(n / n.sum(), means + centre, covs), float(flat[0])


def _pair_costs(mixture: Mixture, j: int) -> np.ndarray:
    """Costs of merging component ``j`` with each of those before it."""
    w, m, c = mixture.weights, mixture.means, mixture.covs
    total = w[:j] + w[j]
    mean = (w[:j, None] * m[:j] + w[j] * m[j]) / total[:, None]
    off_i, off_j = m[:j] - mean, m[j] - mean
    spread_i = c[:j] + off_i[:, :, None] * off_i[:, None, :]
    spread_j = c[j] + off_j[:, :, None] * off_j[:, None, :]
    merged = (w[:j, None, None] * spread_i + w[j] * spread_j) / total[:, None, None]
    log_det, own = np.linalg.slogdet(merged)[1], np.linalg.slogdet(c[: j + 1])[1]
    return w[:j] * (log_det - own[:j]) + w[j] * (log_det - own[j])


def merge_series(mixture: Mixture) -> list[Mixture]:
    """The mixture and every one that ``merge_closest`` makes of it, down to a single component.

    The costs of pairs stay as they are when others merge; only those of the new component are computed.
    """
    series = [mixture]
    costs = np.full((mixture.k, mixture.k), np.inf)
    for j in range(1, mixture.k):
        costs[j, :j] = _pair_costs(mixture, j)
    while series[-1].k > 1:
        current = series[-1]
        # Of equal costs the last pair by larger, then smaller index.
        flat = current.k**2 - 1 - int(costs[::-1, ::-1].argmin())
        j, i = divmod(flat, current.k)
        keep = [c for c in range(current.k) if c not in (i, j)]
        merged = merge_two(current, i, j)
        new = Mixture(
            np.append(current.weights[keep], merged.weights),
            np.concatenate([current.means[keep], merged.means]),
            np.concatenate([current.covs[keep], merged.covs]),
        )
        left = np.full((new.k, new.k), np.inf)
        left[:-1, :-1] = costs[np.ix_(keep, keep)]
        left[-1, :-1] = _pair_costs(new, new.k - 1)
        costs = left
        series.append(new)
    return series


def closest_pair(mixture: Mixture) -> tuple[int, int, Mixture]:
    """The two components whose merger costs least, and the merged one (as a 1-mixture).

    The cost is w_i ln(det C_ij / det C_i) + w_j ln(det C_ij / det C_j); of equal costs the
    last pair (by larger, then smaller index) counts.
    """
    best: tuple[float, int, int] | None = None
    for j in range(1, mixture.k):
        for i, cost in enumerate(_pair_costs(mixture, j)):
            if best is None or cost <= best[0]:
                best = (cost, i, j)
    if best is None:
        raise ValueError("a mixture of one component has no pair")
    return best[1], best[2], merge_two(mixture, best[1], best[2])


def merge_two(mixture: Mixture, i: int, j: int) -> Mixture:
    """One component with the joint moments of components ``i`` and ``j``."""
    share = mixture.weights[[i, j]]
    total = share.sum()
    mean = share @ mixture.means[[i, j]] / total
    off = mixture.means[[i, j]] - mean
    cov = np.einsum("c,cij->ij", share, mixture.covs[[i, j]] + off[:, :, None] * off[:, None, :]) / total
    return Mixture(np.array([total]), mean[None], cov[None])


def merge_closest(mixture: Mixture) -> Mixture:
    """The mixture with its closest pair merged; the merged component comes last."""
    i, j, merged = closest_pair(mixture)
    keep = [c for c in range(mixture.k) if c not in (i, j)]
    return Mixture(
        np.append(mixture.weights[keep], merged.weights),
        np.concatenate([mixture.means[keep], merged.means]),
        np.concatenate([mixture.covs[keep], merged.covs]),
    )
