import random

import numpy as np
import pytest

from loglattice.operators import dbscan as dbscan_module
from loglattice.operators import space_join
from loglattice.operators.dbscan import connected_components, dbscan, neighbour_counts


def near(a, b, eps):
    return sum((x - y) ** 2 for x, y in zip(a, b)) <= eps * eps


def brute(points, eps, m):
    """Plain queue over the rows in order."""
    around = [[j for j, q in enumerate(points) if near(p, q, eps)] for p in points]
    core = [len(a) >= m for a in around]
    label, k = [-1] * len(points), 0
    for i in range(len(points)):
        if not core[i] or label[i] != -1:
            continue
        todo = [i]
        label[i] = k
        while todo:
            u = todo.pop()
            for v in around[u]:
                if label[v] == -1:
                    label[v] = k
                    if core[v]:
                        todo.append(v)
        k += 1
    return label, [len(a) for a in around]


def cloud(d, seed, n=150):
    rng = random.Random(seed)
    out = [[rng.gauss(c, 0.25) for _ in range(d)] for c in (0, 2, 3.1) for _ in range(n // 4)]
    out += [[rng.uniform(-3, 6) for _ in range(d)] for _ in range(n // 4)]
    out += [[5.0] * d] * 20 + [[-2.0] * d] * 3
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("d,seed,direct", [(1, 1, 10**6), (2, 3, 200), (3, 4, 10**6)])
def test_against_brute_force(spark, d, seed, direct):
    points = cloud(d, seed)
    df = spark.createDataFrame(list(enumerate(points)), "row_id long, x array<double>").repartition(3)
    labels, counts = brute(points, 0.5, 5)
    got = {r.row_id: r.label for r in dbscan(df, direct_pairs=direct).collect()}
    assert [got[i] for i in range(len(points))] == labels
    if d == 2:
        got = {r.row_id: r.near for r in neighbour_counts(df, direct_pairs=direct).collect()}
        assert [got[i] for i in range(len(points))] == counts


def wide_cloud(kind, seed, n=160):
    """Points of 12 columns: groups with noise columns, two-valued columns, a thin ring, copies, or one dense ball."""
    rng = random.Random(seed)
    gauss = lambda c, s: [rng.gauss(c, s) for _ in range(12)]
    if kind == "groups":
        points = [gauss(c, 0.1) for c in (0, 1, 1.35) for _ in range(n // 4)] + [gauss(0, 1) for _ in range(n // 4)]
    elif kind == "two-valued":
        points = [[rng.gauss(0, 0.2) for _ in range(8)] + [float(rng.random() < 0.5) for _ in range(4)] for _ in range(n)]
    elif kind == "ring":
        points = []
        for _ in range(n):
            p, r = gauss(0, 1), rng.choice([1, 2.5])
            length = sum(v * v for v in p) ** 0.5
            points.append([v / length * r for v in p])
    else:
        points = [gauss(0, 0.01) for _ in range(n)]
    points += [points[0]] * 7 + [[9.0] * 12] * 4
    rng.shuffle(points)
    return points


@pytest.mark.parametrize("kind,eps,leaf", [("groups", 0.5, 20), ("groups", 0.5, 10_000), ("two-valued", 0.55, 16), ("ring", 0.9, 20), ("ball", 0.5, 20)])
def test_wide_tables_against_brute_force(spark, kind, eps, leaf):
    points = wide_cloud(kind, 5)
    df = spark.createDataFrame(list(enumerate(points)), "row_id long, x array<double>").repartition(3)
    labels, counts = brute(points, eps, 5)
    assert len(set(labels)) > 1 and max(counts) > 5
    got = {r.row_id: r.label for r in dbscan(df, eps=eps, leaf_rows=leaf).collect()}
    assert [got[i] for i in range(len(points))] == labels
    got = {r.row_id: r.near for r in neighbour_counts(df, eps=eps, leaf_rows=leaf).collect()}
    assert [got[i] for i in range(len(points))] == counts


@pytest.mark.parametrize("numbers", [1, 2])
def test_numbers_with_dummies_need_no_pairs_of_points(spark, monkeypatch, numbers):
    """columns of 0 and 1 beside few numbers leave dense cells, not a leaf whose points all meet."""
    monkeypatch.delattr(dbscan_module, "SpaceJoin")
    rng = random.Random(8)
    points = [[rng.choice([rng.gauss(0, 0.2), rng.uniform(-2, 2)]) for _ in range(numbers)] + [float(k == j) for j in range(5)] + [0.5] for k in [rng.randrange(6) for _ in range(150)]]
    points += [points[0]] * 6
    df = spark.createDataFrame(list(enumerate(points)), "row_id long, x array<double>").repartition(3)
    labels, counts = brute(points, 0.3, 5)
    assert len(set(labels)) > 3 and -1 in labels
    got = {r.row_id: r.label for r in dbscan(df, eps=0.3).collect()}
    assert [got[i] for i in range(len(points))] == labels
    got = {r.row_id: r.near for r in neighbour_counts(df, eps=0.3).collect()}
    assert [got[i] for i in range(len(points))] == counts


def test_cuts_follow_groups_and_stop_where_they_do_not_pay():
    rng = np.random.default_rng(3)
    groups = np.concatenate([rng.normal(c, 0.1, (200, 5)) for c in (0, 5, 10, 15)])
    nodes, leaves = space_join.cuts(groups, np.ones(800, bool), 0.5, 250)
    assert leaves == 4
    whole = list(space_join.routed(nodes, groups, np.ones(800, bool), 0.5))
    assert sum(mine.sum() for _, _, mine in whole) == 800 and all(len(rows) == 200 for _, rows, _ in whole)
    assert space_join.cuts(rng.normal(0, 0.01, (500, 5)), np.ones(500, bool), 0.5, 50) == ([], 1)


def test_neighbours_at_the_very_border():
    a = np.array([[0.0, 0.0], [1e6, 1e6]])
    b = np.array([[3.0, 4.0], [1e6 + 3, 1e6 + 4.0000001], [1e6 - 3, 1e6 - 4]])
    assert space_join.within(a, b, 5.0).tolist() == [[True, False, False], [False, False, True]]


def test_long_path_components(spark):
    rng = random.Random(1)
    ids = list(range(40))
    rng.shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in ids + [100, 101, 200]], "node long")
    got = {r.node: r.root for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {100: 100, 101: 100, 200: 200}
