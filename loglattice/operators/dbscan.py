"""Density clustering without pair enumeration inside dense regions.

Equal rows collapse to one weighted point. Space is cut into cells whose diagonal is below
eps, so the points of a cell are mutual neighbours: a cell with at least ``min_points`` rows
holds only core points and is one node of the cluster graph, however many rows it has. What
remains is a question between bounding boxes: a pair of boxes lies within eps as a whole,
lies apart as a whole, or is split into smaller boxes and asked again. The point-by-point
test is used only where its measured work is small.

Columns of two values more than eps apart, which any two neighbours share, become one column of their code: numbers with many
0/1 columns are few columns too. Boxes of more than ``BOX_COLUMNS`` columns say little, so wide tables go another way:
``space_join`` cuts them along all columns, directions of large variance and the norm, and compares points in the leaves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators import ordered as o
from loglattice.operators.lookup import lookup
from loglattice.operators.space_join import LEAF_ROWS, SpaceJoin, equi_columns
from loglattice.session import materialize

NOISE = -1
# Pairs of points tested directly rather than by splitting boxes again.
DIRECT_PAIRS = 20_000_000
# Up to so many columns a grid over the widest ones proposes the pairs of boxes.
BOX_COLUMNS = 3
# Up to so many two-valued columns make one code, whose multiples of eps are exact enough as floating-point numbers.
CODE_COLUMNS = 40


class _Space:
    """The weighted points of one run and the geometry of its cells."""

    def __init__(self, rows: DataFrame, row_id: str, features: str, eps: float, direct_pairs: int) -> None:
        self.eps2, self.direct = eps * eps, direct_pairs
        grouped = rows.groupBy(F.col(features).alias("x")).agg(
            F.count(F.lit(1)).alias("w"), F.min(row_id).alias("first_row")
        )
        points = materialize(grouped.withColumn("pid", F.monotonically_increasing_id()))
        self.d = points.select(F.max(F.size("x")).alias("d")).first()["d"] or 0
        # ``given`` keeps the columns of the caller; the column of codes needs no neighbouring cells.
        self.given, self.code = points, None
        if self.d > BOX_COLUMNS:
            points, self.d, self.code = _fewer_columns(points, self.d, eps)
        self.reduced = points is not self.given
        # The smallest halving of eps whose cell diagonal is strictly below eps.
        self.base = next(h for h in itertools.count(1) if 2**h > math.sqrt(self.d))
        self.eps = eps
        self.points = points if self.d > BOX_COLUMNS else points.withColumn("cell", self.key(F.col("x"), self.base))
        if self.d > BOX_COLUMNS:
            return
        spread = points.agg(
            *[(F.max(F.col("x")[j]) - F.min(F.col("x")[j])).alias(f"s{j}") for j in range(self.d)]
        ).first()
        widest = sorted(range(self.d), key=lambda j: -(spread[j] or 0))
        self.grid = sorted(widest[:BOX_COLUMNS])

    def key(self, x: Column, level: int) -> Column:
        side = self.eps / 2**level
        return F.array(*[F.floor(x[j] / F.lit(side)).cast("long") for j in range(self.d)])

    def boxes(self, points: DataFrame, level: int, *by: str) -> DataFrame:
        """Bounding boxes of the points per cell of ``level``: rows ``n``, distinct points ``m``."""
        x = F.col("x")
        return points.groupBy(*by, self.key(x, level).alias("key")).agg(
            F.sum("w").alias("n"),
            F.count(F.lit(1)).alias("m"),
            F.array(*[F.min(x[j]) for j in range(self.d)]).alias("lo"),
            F.array(*[F.max(x[j]) for j in range(self.d)]).alias("hi"),
        )

    def as_boxes(self, points: DataFrame, *by: str) -> DataFrame:
        x = F.col("x")
        return points.select(
            *by, F.array(F.col("pid")).alias("key"), F.col("w").alias("n"), F.lit(1).cast("long").alias("m"),
            x.alias("lo"), x.alias("hi"),
        )

    def gap2(self) -> Column:
        """Squared distance between the nearest points of boxes ``a`` and ``b``."""
        parts = [
            F.greatest(F.lit(0.0), F.col("b_lo")[j] - F.col("a_hi")[j], F.col("a_lo")[j] - F.col("b_hi")[j])
            for j in range(self.d)
        ]
        return sum((p * p for p in parts[1:]), parts[0] * parts[0])

    def span2(self) -> Column:
        """Squared distance between the farthest points of boxes ``a`` and ``b``."""
        parts = [
            F.greatest(
                F.abs(F.col("b_hi")[j] - F.col("a_lo")[j]), F.abs(F.col("a_hi")[j] - F.col("b_lo")[j])
            )
            for j in range(self.d)
        ]
        return sum((p * p for p in parts[1:]), parts[0] * parts[0])

    def coarse(self, side: str) -> list[Column]:
        width = self.eps * (1 + 0.5**self.base)
        return [F.floor(F.col(f"{side}_lo")[j] / F.lit(width)).cast("long") for j in self.grid]

    def near(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of boxes within eps; a grid over the widest columns proposes them."""
        a, b = _side(left, "a"), _side(right, "b")
        here = self.coarse("a")
        around = [
            F.array(*[c + F.lit(k) for c, k in zip(here, shift)])
            for shift in itertools.product(*[(0,) if j == self.code else (-1, 0, 1) for j in self.grid])
        ]
        a = a.withColumn("grid", F.explode(F.array(*around)))
        b = materialize(b.withColumn("grid", F.array(*self.coarse("b"))))
        pairs = lookup(a, b, ["grid"], "inner").drop("grid")
        return pairs.where(self.gap2() <= self.eps2)


def _fewer_columns(points: DataFrame, d: int, eps: float) -> tuple[DataFrame, int, int | None]:
    """The points in at most ``BOX_COLUMNS`` columns with the same neighbours within eps, how many, and which is the code; or as they are.

    Columns of one value tell nothing apart; those of two values more than eps apart become one column, their code times twice
    eps. A table with a value that is no finite number stays as it is.
    """
    x = F.col("x")
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (F.size("x") == d)
    if not points.where(~F.coalesce(finite, F.lit(False))).isEmpty():
        return points, d, None
    same, two = equi_columns(points, d, eps)
    rest = [j for j in range(d) if j not in two and j not in same]
    if len(rest) + bool(two) > BOX_COLUMNS or len(two) > CODE_COLUMNS:
        return points, d, None
    code = sum((F.when(x[j] > low, 1 << i).otherwise(0).cast("long") for i, (j, low) in enumerate(two.items())), F.lit(0).cast("long"))
    columns = [x[j] for j in rest] + ([code * F.lit(2 * eps)] if two else [])
    fewer = materialize(points.withColumn("x", F.array(*(columns or [F.lit(0.0)]))))
    return fewer, max(1, len(columns)), len(rest) if two else None


def _side(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{name}_{c}") for c in boxes.columns])


def _parts(space: _Space, pairs: DataFrame, side: str, points: DataFrame, level: int, tags: list[str], direct: bool) -> DataFrame:
    """Replace one side's boxes of ``level`` by their parts: smaller boxes, or single points."""
    asked = materialize(pairs.select(F.col(f"{side}_key").alias("parent")).distinct())
    inside = lookup(points.withColumn("parent", space.key(F.col("x"), level)), asked, ["parent"], "left_semi")
    parts = space.as_boxes(inside, "parent", *tags) if direct else space.boxes(inside, level + 1, "parent", *tags)
    parts = _side(parts, side).withColumnRenamed(f"{side}_parent", "parent")
    others = [c for c in pairs.columns if not c.startswith(f"{side}_")]
    rest = pairs.select(F.col(f"{side}_key").alias("parent"), *others)
    # The measured work bounds the output of a direct join; box parts are few per parent.
    joined = rest.join(parts, "parent") if direct else lookup(rest, materialize(parts), ["parent"], "inner")
    return joined.drop("parent")


def _resolve(
    space: _Space,
    pairs: DataFrame,
    points: DataFrame,
    tags: list[str],
    inside: Callable[[DataFrame], DataFrame],
    still_open: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    both_sides: bool = False,
) -> DataFrame:
    """Decide every pair of boxes; ``inside`` summarises the pairs that lie within eps whole.

    ``still_open(undecided, found)`` drops the pairs whose answer no longer matters. The right
    side (and with ``both_sides`` the left) is made of ``points``, tagged with ``tags``.
    """
    level, found = space.base, None
    while True:
        pairs = materialize(pairs.withColumn("whole", space.span2() <= space.eps2))
        now = inside(pairs.where("whole"))
        found = materialize(now if found is None else found.unionByName(now))
        undecided = materialize(still_open(pairs.where("NOT whole").drop("whole"), found))
        work = undecided.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a_m") * F.col("b_m")).alias("w")).first()
        if work.n == 0:
            return found
        direct = work.w <= space.direct
        pairs = _parts(space, undecided, "b", points, level, tags, direct)
        if both_sides:
            pairs = _parts(space, pairs, "a", points, level, tags, direct)
        pairs = pairs.where(space.gap2() <= space.eps2)
        level += 1


def _counts(space: _Space, queries: DataFrame, enough: int | None) -> DataFrame:
    """``(pid, near)``: rows within eps of each query point, itself included.

    With ``enough`` a count stops growing once it has reached that number.
    """
    cells = space.boxes(space.points, space.base)
    pairs = space.near(space.as_boxes(queries, "pid"), cells)

    def inside(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("a_pid").alias("pid")).agg(F.sum("b_n").alias("near"))

    def still_open(df: DataFrame, found: DataFrame) -> DataFrame:
        if enough is None:
            return df
        sure = found.groupBy("pid").agg(F.sum("near").alias("near")).where(F.col("near") >= enough)
        return df.join(sure.select(F.col("pid").alias("a_pid")), "a_pid", "left_anti")

    found = _resolve(space, pairs, space.points, [], inside, still_open)
    return found.groupBy("pid").agg(F.sum("near").alias("near"))


def neighbour_counts(
    rows: DataFrame, *, eps: float = 0.5, row_id: str = "row_id", features: str = "x",
    direct_pairs: int = DIRECT_PAIRS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(row_id, near)``: the number of rows within eps of each row, itself included."""
    space = _Space(rows, row_id, features, eps, direct_pairs)
    if space.d > BOX_COLUMNS:
        counts = SpaceJoin(space.points.select("pid", "w", "x"), space.d, eps, leaf_rows=leaf_rows).counts()
    else:
        counts = _counts(space, space.points, None)
    per_point = materialize(space.given.join(counts, "pid").select(F.col("x").alias(features), "near"))
    return lookup(rows.select(row_id, features), per_point, [features], "inner").select(row_id, "near")


def connected_components(nodes: DataFrame, edges: DataFrame, *, steps: int = 2) -> DataFrame:
    """``(node, root)`` for ``nodes(node)`` and ``edges(a, b)``; the root is the smallest node.

    In every step a root adopts the smallest root next to its tree and paths are halved, so
    the number of steps grows with the logarithm of the component size. ``steps`` of them run
    before the roots are stored and compared. A root many nodes share is a hot join key, which
    the skew join splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())

    def advance(roots: DataFrame) -> DataFrame:
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("low"))
        near = both.join(at_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        hooks = roots.join(near, "node").groupBy("root").agg(F.min("low").alias("low"))
        moved = roots.join(hooks, "root", "left")
        moved = moved.select("node", F.least("root", "low").alias("root"))
        above = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
        return moved.join(above, "root").select("node", F.col("top").alias("root"))

    roots = materialize(nodes.select("node", F.col("node").alias("root")))
    while True:
        new = roots
        for _ in range(steps):
            new = advance(new)
        new = materialize(new)
        before = roots.select("node", F.col("root").alias("before"))
        if new.join(before, "node").where("root <> before").isEmpty():
            return new
        roots = new


def dbscan(
    rows: DataFrame, *, eps: float = 0.5, min_points: int = 5, row_id: str = "row_id", features: str = "x",
    direct_pairs: int = DIRECT_PAIRS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(row_id, label)`` for ``rows`` with an ARRAY<DOUBLE> column ``features``.

    A row with at least ``min_points`` rows within ``eps`` (itself included) is a core row;
    connected core rows form a cluster, other rows within eps of a core row join the first
    such cluster, the rest is labelled -1. Clusters are numbered by their first core row.
    """
    space = _Space(rows, row_id, features, eps, direct_pairs)
    per_point = _wide_labels(space, min_points, leaf_rows) if space.d > BOX_COLUMNS else _box_labels(space, min_points)
    if space.reduced:
        per_point = lookup(space.given.select("pid", "x"), materialize(per_point.select("pid", "label")), ["pid"], "inner")
    per_point = materialize(per_point.select(F.col("x").alias(features), "label"))
    out = lookup(rows.select(row_id, features), per_point, [features])
    return out.select(row_id, F.coalesce("label", F.lit(NOISE)).alias("label"))


def _numbered(roots: DataFrame, first: DataFrame) -> DataFrame:
    """Stored ``(node, label)``: the trees of ``roots (node, root)`` numbered by the first row of ``first (node, first_row)``."""
    named = roots.join(first, "node").groupBy("root").agg(F.min("first_row").alias("first_row"))
    named = o.OrderedGroups(named.withColumn("all", F.lit(0)), ["all"], ["first_row", "root"]).scan(nth=o.position()).df
    named = materialize(named.select("root", (F.col("nth") - 1).cast("int").alias("label")))
    return materialize(lookup(roots, named, ["root"], "inner").select("node", "label"))


def _wide_labels(space: _Space, min_points: int, leaf_rows: int) -> DataFrame:
    """``(x, label)`` of the points in a cluster, by cuts of the space and two passes over its leaves."""
    join = SpaceJoin(space.points.select("pid", "w", "x"), space.d, space.eps, leaf_rows=leaf_rows)
    core = materialize(join.counts(min_points).where(F.col("near") >= min_points).select("pid"))
    links, border = join.links(core)
    roots = connected_components(core.select(F.col("pid").alias("node")), links)
    labels = _numbered(roots, space.points.select(F.col("pid").alias("node"), "first_row"))
    inside = labels.select(F.col("node").alias("pid"), "label")
    beside = lookup(border, labels.withColumnRenamed("node", "core"), ["core"], "inner").groupBy("pid").agg(F.min("label").alias("label"))
    found = materialize(inside.unionByName(beside))
    return lookup(space.points, found, ["pid"], "inner").select("x", "label")


def _box_labels(space: _Space, min_points: int) -> DataFrame:
    """``(pid, x, label)`` of the points in a cluster, by boxes."""
    sizes = space.points.groupBy("cell").agg(F.sum("w").alias("n"))
    dense = materialize(sizes.where(F.col("n") >= min_points).select("cell"))
    sparse = materialize(lookup(space.points, dense, ["cell"], "left_anti"))
    counts = _counts(space, sparse, min_points)
    sure = materialize(counts.where(F.col("near") >= min_points).select("pid"))
    core = materialize(
        lookup(space.points, dense, ["cell"], "left_semi").unionByName(sparse.join(sure, "pid", "left_semi"))
    )
    loose = sparse.join(sure, "pid", "left_anti")

    cells = space.boxes(core, space.base, "cell").withColumn("node", F.monotonically_increasing_id())
    cells = materialize(cells)
    core = lookup(core, cells.select("cell", "node"), ["cell"], "inner")
    boxes = cells.drop("cell")
    pairs = space.near(boxes, boxes).where("a_node < b_node")

    def linked(df: DataFrame) -> DataFrame:
        return df.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()

    def unlinked(df: DataFrame, found: DataFrame) -> DataFrame:
        known = found.select(F.col("a").alias("a_node"), F.col("b").alias("b_node"))
        return df.join(known, ["a_node", "b_node"], "left_anti")

    edges = _resolve(space, pairs, core, ["node"], linked, unlinked, both_sides=True)
    roots = connected_components(cells, edges)

    labels = _numbered(roots, core.groupBy("node").agg(F.min("first_row").alias("first_row")))

    core = lookup(core, labels, ["node"], "inner")
    near_core = space.near(space.as_boxes(loose, "pid"), boxes.join(labels, "node").drop("node"))

    def adjacent(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("a_pid").alias("pid")).agg(F.min("b_label").alias("label"))

    border = _resolve(space, near_core, core, ["label"], adjacent, lambda df, _: df)
    border = border.groupBy("pid").agg(F.min("label").alias("label"))
    return core.select("pid", "x", "label").unionByName(loose.join(border, "pid").select("pid", "x", "label"))
