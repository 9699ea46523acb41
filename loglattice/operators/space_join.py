"""Neighbours within eps in wide tables: equal keys, recursive cuts with an eps border, dense tiles in the leaves.

* Columns of two values that lie more than eps apart split the points by an equi-key: neighbours agree on all of them.
* Every other cut uses a feature that changes by no more than the distance between two points: a column, a
  direction of large variance, or the norm around the mean (its cuts are rings). A leaf is cut at the median of the
  feature that leaves the least work; points within eps of the cut are copied to the other side as guests.
* Cuts are chosen on a bounded sample of a leaf; each round cuts all leaves above ``leaf_rows`` at once. A leaf that no
  cut makes cheaper is settled: it is dealt to blocks along its widest feature, and only blocks within eps meet.
* A task compares two blocks by matrix products and rechecks pairs at the very border by differences. Each point is owned by one
  leaf, which holds all points within eps of it, so a pair counts once for each end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.lookup import lookup
from loglattice.session import materialize

LEAF_ROWS = 8192
#: Sampled rows of a leaf, and leaves that one round makes of one leaf at most.
SAMPLE = 4096
FAN_OUT = 64
#: Leaves in all: bounds the cuts the driver hands out, beyond it leaves grow.
MOST_LEAVES = 100_000
DIRECTIONS = 8
TILE = 1024


@dataclass
class Features:
    """Functions that change by no more than the distance: columns, unit directions, the norm around a centre."""

    centre: np.ndarray
    directions: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        off = x - self.centre
        return np.column_stack([off, off @ self.directions, np.sqrt((off * off).sum(axis=1))])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _features(points: DataFrame, d: int) -> Features:
    """Principal directions of a bounded sample; any unit directions would do."""
    n = points.count()
    part = points if n <= SAMPLE else points.where(F.pmod(F.xxhash64("pid"), F.lit(n)) < SAMPLE)
    x = np.array([r["x"] for r in part.select("x").limit(2 * SAMPLE).collect()], float).reshape(-1, d)
    if not len(x):
        return Features(np.zeros(d), np.zeros((d, 0)))
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    return Features(x.mean(axis=0), vectors[:, ::-1][:, :DIRECTIONS])


def equi_columns(points: DataFrame, d: int, eps: float) -> tuple[set[int], dict[int, float]]:
    """Columns of one value; columns of two values more than eps apart, and their smaller value."""
    x = F.col("x")
    ends = points.agg(*[f(x[j]).alias(f"{n}{j}") for j in range(d) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    wide = [j for j in range(d) if ends[f"lo{j}"] is not None and ends[f"hi{j}"] - ends[f"lo{j}"] > eps]
    same = {j for j in range(d) if ends[f"lo{j}"] is not None and ends[f"hi{j}"] == ends[f"lo{j}"]}
    if not wide:
        return same, {}
    inside = points.agg(*[F.count_if((x[j] > ends[f"lo{j}"]) & (x[j] < ends[f"hi{j}"])).alias(f"c{j}") for j in wide]).first()
    return same, {j: ends[f"lo{j}"] for j in wide if inside[f"c{j}"] == 0}


def cuts(values: np.ndarray, own: np.ndarray, border: float, leaf_rows: float) -> tuple[list[tuple[int, float, int, int]], int]:
    """Cut tree of sampled feature values: nodes (feature, cut, left, right), where ~i is leaf i; and the number of leaves.

    The work of a leaf is its owned rows times its rows. A cut must save a fifth of it, so cutting ends.
    """
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray, owned: np.ndarray, budget: int) -> int:
        nonlocal leaves
        best = None
        if len(rows) > leaf_rows and budget > 1 and len(owned) > 1:
            mine, every = values[owned], values[rows]
            spread = mine.max(axis=0) - mine.min(axis=0)
            for f in np.argsort(-spread)[:24]:
                if spread[f] <= border:
                    break
                cut = float(np.median(mine[:, f]))
                left = int((mine[:, f] <= cut).sum())
                right = len(mine) - left
                work = left * int((every[:, f] <= cut + border).sum()) + right * int((every[:, f] > cut - border).sum())
                if right and (best is None or work < best[0]):
                    best = (work, int(f), cut)
        if best is None or best[0] > 0.8 * len(rows) * len(owned):
            leaves += 1
            return ~(leaves - 1)
        _, f, cut = best
        at = len(nodes)
        nodes.append((f, cut, 0, 0))
        left = grow(rows[values[rows, f] <= cut + border], owned[values[owned, f] <= cut], budget // 2)
        right = grow(rows[values[rows, f] > cut - border], owned[values[owned, f] > cut], budget - budget // 2)
        nodes[at] = (f, cut, left, right)
        return at

    grow(np.arange(len(values)), np.flatnonzero(own), FAN_OUT)
    return nodes, leaves


def routed(nodes: list[tuple[int, float, int, int]], values: np.ndarray, own: np.ndarray, border: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, owned) of all rows that reach a leaf."""
    waiting = [(0 if nodes else ~0, np.arange(len(values)), own)]
    while waiting:
        at, rows, mine = waiting.pop()
        if at < 0:
            yield ~at, rows, mine
            continue
        f, cut, left, right = nodes[at]
        v = values[rows, f]
        low, high = v <= cut + border, v > cut - border
        waiting += [(left, rows[low], (mine & (v <= cut))[low]), (right, rows[high], (mine & (v > cut))[high])]


ROW = "leaf long, settled boolean, blk int, f double, own boolean, pid long, w long, x array<double>"


class SpaceJoin:
    """The dealt points of one run: stored rows of tasks, a task being two blocks of a leaf that may hold neighbours."""

    def __init__(self, points: DataFrame, d: int, eps: float, *, leaf_rows: int = LEAF_ROWS) -> None:
        """``points (pid, w, x)`` are stored and distinct."""
        self.d, self.eps, self.leaf_rows = d, eps, leaf_rows
        self.features = _features(points, d)
        scale = float(np.abs(self.features.centre).max(initial=0)) + eps
        self.border = eps * (1 + 1e-9) + 1e-12 * scale
        equi = equi_columns(points, d, eps)[1]
        key = F.xxhash64(F.array(*[F.col("x")[j] > lo for j, lo in equi.items()])) if equi else F.lit(0).cast("long")
        start = points.select(
            key.alias("leaf"), F.lit(False).alias("settled"), F.lit(0).alias("blk"), F.lit(0.0).alias("f"), F.lit(True).alias("own"), "pid", F.col("w").cast("long").alias("w"), "x"
        )
        self.rows = self._cut(materialize(start))
        self.tasks = self._paired()

    def _cut(self, rows: DataFrame) -> DataFrame:
        while True:
            sizes = materialize(rows.groupBy("leaf", "settled").agg(F.count(F.lit(1)).alias("n")))
            limit = max(self.leaf_rows, (sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) // MOST_LEAVES)
            large = materialize(sizes.where(~F.col("settled") & (F.col("n") > limit)).select("leaf", "n"))
            if large.isEmpty():
                return rows
            sampled = lookup(rows, large, ["leaf"], "inner").where(F.pmod(F.xxhash64("pid", "leaf"), F.col("n")) < SAMPLE).select("leaf", "n", "own", "x")
            trees = {t["leaf"]: t for t in sampled.groupBy("leaf").applyInPandas(self._tree(limit), "leaf long, n long, feature array<int>, cut array<double>, lower array<int>, upper array<int>, edges array<double>, widest int").collect()}
            rows = materialize(rows.mapInArrow(self._router(trees), ROW))

    def _tree(self, limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        features, border = self.features, self.border

        def build(group: pd.DataFrame) -> pd.DataFrame:
            n, values = int(group["n"].iloc[0]), features.of(np.stack(group["x"].to_list()))
            nodes, _ = cuts(values, group["own"].to_numpy(bool), border, limit * len(values) / n)
            widest = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
            blocks = -(-n // limit)
            edges = np.unique(np.quantile(values[:, widest], np.arange(1, blocks) / blocks)) if not nodes else np.zeros(0)
            f, c, lower, upper = (list(z) for z in zip(*nodes)) if nodes else ([], [], [], [])
            return pd.DataFrame({"leaf": [group["leaf"].iloc[0]], "n": [n], "feature": [f], "cut": [c], "lower": [lower], "upper": [upper], "edges": [edges.tolist()], "widest": [widest]})

        return build

    def _router(self, trees: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        features, border, d = self.features, self.border, self.d
        plans = {k: (list(zip(t["feature"], t["cut"], t["lower"], t["upper"])), np.array(t["edges"]), t["widest"]) for k, t in trees.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, own = batch.column("leaf").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
                for key in np.unique(leaf).tolist():
                    at = np.flatnonzero(leaf == key)
                    part = batch.take(pa.array(at))
                    if key not in plans or part.column("settled")[0].as_py():
                        yield part
                        continue
                    nodes, edges, widest = plans[key]
                    values = features.of(matrix(part.column("x"), d))
                    for i, rows, mine in routed(nodes, values, own[at], border):
                        if not len(rows):
                            continue
                        out = part.take(pa.array(rows))
                        f = values[rows, widest] if not nodes else np.zeros(len(rows))
                        now = {
                            "leaf": np.full(len(rows), key if not nodes else _child(key, i)), "settled": np.full(len(rows), not nodes),
                            "blk": np.searchsorted(edges, f).astype(np.int32), "f": f, "own": mine,
                        }
                        yield pa.RecordBatch.from_arrays([pa.array(now[c]) if c in now else out.column(c) for c in out.schema.names], schema=out.schema)

        return run

    def _paired(self) -> DataFrame:
        """Rows (leaf, i, j, block, own, pid, w, x): once for each task of the row's block."""
        counts = self.rows.groupBy("leaf", "blk").agg(F.count(F.lit(1)).alias("n"))
        parts = materialize(counts.select("leaf", "blk", F.ceil(F.col("n") / (4 * self.leaf_rows)).cast("int").alias("parts")).where("parts > 1"))
        # Ties of the widest feature may fill a block beyond the limit: its rows are dealt by a hash.
        part = F.coalesce(F.pmod(F.xxhash64("pid"), F.col("parts")), F.lit(0))
        rows = lookup(self.rows, parts, ["leaf", "blk"]).withColumn("block", F.col("blk") * F.lit(1 << 32) + part).drop("parts", "blk", "settled")
        blocks = materialize(rows.groupBy("leaf", "block").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.max("own").alias("own")))
        left = blocks.select("leaf", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.col("own").alias("own_i"))
        right = blocks.select("leaf", F.col("block").alias("j"), "lo", "hi", "own")
        apart = (F.col("lo") - F.col("hi_i") > self.border) | (F.col("lo_i") - F.col("hi") > self.border)
        pairs = left.join(right, "leaf").where((F.col("i") <= F.col("j")) & ~apart & (F.col("own_i") | F.col("own"))).select("leaf", "i", "j")
        ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
        return materialize(rows.drop("f").join(pairs.select("leaf", "i", "j", ends), ["leaf", "block"]).select("leaf", "i", "j", "block", "own", "pid", "w", "x"))

    def _grouped(self, rows: DataFrame, columns: list[str], schema: str, kernel: Callable[[dict[str, np.ndarray]], Iterator[dict]]) -> DataFrame:
        """``kernel`` over the rows of each task, one task after the other."""
        key = ["leaf", "i", "j"]
        names, d = ["block", "own", "pid", "w", *columns], self.d
        dealt = rows.select(*key, *names, "x").repartition(*key).sortWithinPartitions(*key, "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def done() -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks()
                group = {c: table.column(c).to_numpy() for c in names}
                group["x"] = np.concatenate([matrix(c, d) for c in table.column("x").chunks])
                for out in kernel(group):
                    yield pa.RecordBatch.from_pydict(out)

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([batch.column(c).to_numpy() for c in key])
                edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:]):
                    part = batch.slice(a, b - a)
                    if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in key):
                        yield from done()
                        held = []
                    held.append(part)
            if held:
                yield from done()

        return dealt.mapInArrow(run, schema)

    def counts(self, enough: int | None = None) -> DataFrame:
        """``(pid, near)``: rows within eps of each point, itself included; with ``enough`` a task stops counting a point there."""
        eps = self.eps

        def kernel(group: dict[str, np.ndarray]) -> Iterator[dict]:
            x = group["x"]
            total = np.zeros(len(x), np.int64)
            for q, t in sides(group):
                for at in range(0, len(t), TILE):
                    to = t[at : at + TILE]
                    open_ = q if enough is None else q[total[q] < enough]
                    for k in range(0, len(open_), TILE):
                        now = open_[k : k + TILE]
                        total[now] += within(x[now], x[to], eps) @ group["w"][to]
            own = np.flatnonzero(group["own"])
            yield {"pid": group["pid"][own], "near": total[own]}

        found = self._grouped(self.tasks, [], "pid long, near long", kernel)
        return found.groupBy("pid").agg(F.sum("near").alias("near"))

    def links(self, core: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For the points ``core (pid)``: links (a, b) that connect all core points within eps, and (pid, core) that names
        for every other point one core point of each group next to it that its task knows of."""
        eps = self.eps
        marked = lookup(self.tasks, materialize(core.select("pid", F.lit(True).alias("is_core"))), ["pid"]).withColumn("is_core", F.coalesce("is_core", F.lit(False)))

        def kernel(group: dict[str, np.ndarray]) -> Iterator[dict]:
            x, core_, pid = group["x"], group["is_core"].astype(bool), group["pid"]
            label = np.arange(len(x))
            touching: list[np.ndarray] = []
            for q, t in sides(group):
                t = t[core_[t]]
                for at in range(0, len(t), TILE):
                    to = t[at : at + TILE]
                    for k in range(0, len(q), TILE):
                        now = q[k : k + TILE]
                        ends = label[np.concatenate([now[core_[now]], to])]
                        if core_[now].all() and ends.min() == ends.max():
                            continue  # one group already
                        i, j = np.nonzero(within(x[now], x[to], eps))
                        a, b = now[i], to[j]
                        linked = core_[a]
                        label = united(label, a[linked], b[linked])
                        if not linked.all():
                            touching.append(np.stack([a[~linked], b[~linked]]))
            moved = np.flatnonzero(core_ & (label != np.arange(len(x))))
            yield {"a": pid[moved], "b": pid[label[moved]], "border": np.zeros(len(moved), bool)}
            if touching:
                pairs = np.concatenate(touching, axis=1)
                pairs = np.unique(np.stack([pairs[0], label[pairs[1]]]), axis=1)
                yield {"a": pid[pairs[0]], "b": pid[pairs[1]], "border": np.ones(pairs.shape[1], bool)}

        found = materialize(self._grouped(marked, ["is_core"], "a long, b long, border boolean", kernel))
        return found.where("NOT border").select("a", "b"), found.where("border").select(F.col("a").alias("pid"), F.col("b").alias("core"))


def _child(leaf: int, i: int) -> int:
    """A number of a new leaf: 64 bits spread from its parent and its number there (equal numbers only merge leaves' rows)."""
    z = (leaf * 0x9E3779B97F4A7C15 + (i + 1) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    z = ((z ^ z >> 30) * 0x94D049BB133111EB) & (1 << 64) - 1
    return (z ^ z >> 31) - (1 << 63)


def sides(group: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owned rows, rows of the block they meet) of a task: a block with itself, or two blocks both ways."""
    block, own = group["block"], group["own"].astype(bool)
    first = block == block[0]
    if first.all():
        yield np.flatnonzero(own), np.arange(len(block))
    else:
        yield np.flatnonzero(own & first), np.flatnonzero(~first)
        yield np.flatnonzero(own & ~first), np.flatnonzero(first)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs of rows lie within eps; pairs too close to call by the product are decided by their differences."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), bool)
    centre = b.mean(axis=0)
    u, v = a - centre, b - centre
    nu, nv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    d2 = nu[:, None] + nv[None, :] - 2 * (u @ v.T)
    limit = eps * eps
    doubt = 1e-11 * (nu.max(initial=0) + nv.max(initial=0) + limit)
    near = d2 <= limit
    i, j = np.nonzero(np.abs(d2 - limit) <= doubt)
    for at in range(0, len(i), 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        total = np.zeros(len(p))
        for k in range(a.shape[1]):
            step = a[p, k] - b[q, k]
            total += step * step
        near[p, q] = total <= limit
    return near


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Group numbers after the links (i, j); the smallest row of a group stands for it."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]
