"""Clustering, mixtures, density clusters and feature selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from loglattice.operators import clustering, dbscan, selection
from loglattice.operators import mixture as mx
from loglattice.operators.scaling import z_score
from loglattice.session import materialize, shared_folder
from loglattice.sources import tables
from workload.hash_sql import hashed
from workload.registry import query, rounded, table, with_


def vectors(spark, folder):
    """All embeddings with their first coordinates as columns."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("x"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
    )


def plane_points(spark, folder, *columns):
    """Embeddings reduced to an array of a few coordinates."""
    return vectors(spark, folder).select("row_id", "label", F.array(*columns).alias("x"))


E = "e AS (SELECT vec_id AS row_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(4)) + " FROM embeddings)"


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, folder):
    return clustering.label_sizes(table(spark, folder, "embeddings").select("label"))


def label_centers(spark, folder):
    long = vectors(spark, folder).select("label", F.posexplode("x").alias("i", "v"))
    means = long.groupBy("label", "i").agg(F.avg("v").alias("m"))
    entries = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(F.col("label").alias("center")).agg(F.transform(entries, lambda s: s.getField("m")).alias("c"))


DISTANCES = """long_ AS (SELECT vec_id AS row_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT label AS center, i, avg(v) AS m FROM long_ GROUP BY ALL),
far AS (SELECT row_id, center, sqrt(sum((v - m) * (v - m))) AS distance FROM long_ JOIN means USING (i) GROUP BY ALL)"""


@query(with_(DISTANCES) + "SELECT row_id, center, round(distance, 6) AS distance FROM far")
def center_distances(spark, folder):
    return rounded(clustering.center_distances(vectors(spark, folder), label_centers(spark, folder)), "distance")


@query(
    with_(DISTANCES)
    + """SELECT row_id, arg_min(center, distance) AS label, round(min(distance), 6) AS distance FROM far GROUP BY row_id"""
)
def nearest_center(spark, folder):
    return rounded(clustering.nearest_center(vectors(spark, folder), label_centers(spark, folder)), "distance")


def _learnable(spark, folder):
    return clustering.with_vector(vectors(spark, folder), "x")


_TEST = f"""test AS (SELECT x AS row_id FROM ({hashed("SELECT vec_id AS x FROM embeddings", 4)})
  WHERE (CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h + 4 ELSE h END) % 10 = 0)"""


def _given_is_nearest(rows, models):
    """``(k, row_id, nearest)``: whether a model's label is the centre that is nearest by distance."""
    labels = clustering.predict(rows, models)
    out = None
    for k, model in models.items():
        near = clustering.nearest_center(rows, clustering.centers_of(model, rows)).select("row_id", F.col("label").alias("near"))
        one = labels.where(F.col("k") == k).join(near, "row_id")
        one = one.select(F.col("k").cast("long").alias("k"), "row_id", (F.col("label") == F.col("near")).alias("nearest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT k, vec_id AS row_id, true AS nearest FROM embeddings, (SELECT unnest(range(2, 7)) AS k)")
def kmeans_sweep(spark, folder):
    """Train on one part, label every row for each k: each label is the nearest centre."""
    rows = _learnable(spark, folder)
    train, _ = clustering.train_test(rows)
    return _given_is_nearest(rows, clustering.kmeans_sweep(train))


@query("SELECT k, (SELECT count(*) FROM embeddings) AS n, k AS labels FROM (SELECT unnest(range(2, 7)) AS k)")
def kmeans_totals(spark, folder):
    """Every row has one label for every k, and every label is a number below k."""
    rows = _learnable(spark, folder)
    labels = clustering.predict(rows, clustering.kmeans_sweep(rows))
    sizes = clustering.label_sizes(labels, clustering.DEFAULT_K)
    totals = sizes.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    return totals.select(F.col("k").cast("long").alias("k"), "n", "labels")


@query("SELECT vec_id AS row_id, true AS nearest FROM embeddings")
def kmeans_labels_are_nearest(spark, folder):
    """The label a fitted model gives a row is the centre that is nearest to it."""
    rows = _learnable(spark, folder)
    return _given_is_nearest(rows, clustering.kmeans_sweep(rows, [8])).select("row_id", "nearest")


@query(with_(_TEST) + "SELECT k, row_id, true AS nearest FROM test, (SELECT unnest(range(2, 7)) AS k)")
def kmeans_test_labels(spark, folder):
    """Labels of the held-out rows: which rows those are, and that each label is the nearest centre."""
    train, test = clustering.train_test(_learnable(spark, folder))
    return _given_is_nearest(test, clustering.kmeans_sweep(train))


@query("SELECT unnest(range(0, 10)) AS label, true AS centre_is_mean")
def kmeans_fit_predict(spark, folder):
    """At convergence the ten centres are the means of the rows that have their label."""
    rows = _learnable(spark, folder)
    labelled = rows.drop("label").join(clustering.fit_predict(rows, [10], tol=1e-9, max_iter=300), "row_id")
    means = labelled.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    entries = F.array_sort(F.collect_list(F.struct("i", "m")))
    means = means.groupBy(F.col("label").alias("mean_of")).agg(F.transform(entries, lambda e: e["m"]).alias("m"))
    model = clustering.kmeans_sweep(rows, [10], tol=1e-9, max_iter=300)[10]
    pairs = means.join(clustering.centers_of(model, rows), F.col("mean_of") == F.col("center"))
    far = F.aggregate(F.zip_with("m", "c", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    return pairs.select(F.col("center").cast("long").alias("label"), (far < 1e-6).alias("centre_is_mean"))


@query("SELECT vec_id AS row_id, true AS same FROM embeddings")
def kmeans_stored_and_loaded(spark, folder):
    """A stored model labels every row as the one it was stored from."""
    rows, name = _learnable(spark, folder), tables.new_name("km_5")
    model = clustering.kmeans_sweep(rows, [5])[5]
    tables.store_model(spark, model, shared_folder(spark), name)
    loaded = tables.load_model(spark, KMeansModel, shared_folder(spark), name)
    both = clustering.add_label(clustering.add_label(rows, model, label="a"), loaded, label="b")
    return both.select("row_id", (F.col("a") == F.col("b")).alias("same"))


@query("SELECT vec_id AS row_id, true AS same FROM embeddings")
def mixture_stored_and_loaded(spark, folder):
    """A stored mixture over all 64 coordinates labels every row as the one it was stored from."""
    rows, name = _learnable(spark, folder), tables.new_name("gmm_4")
    model = clustering.gmm_sweep(rows, [4])[4]
    tables.store_model(spark, model, shared_folder(spark), name)
    loaded = tables.load_model(spark, mx.Mixture, shared_folder(spark), name)
    both = clustering.add_label(clustering.add_label(rows, model, label="a"), loaded, label="b")
    return both.select("row_id", (F.col("a") == F.col("b")).alias("same"))


def _log_joint(m, x):
    """log(weight * density) of every component as an array, for an array column ``x``; from the inverse
    covariances, where the library solves with their roots."""
    inverses = [np.linalg.inv(c) for c in m.covs]
    constants = [np.log(w) - 0.5 * (np.linalg.slogdet(c)[1] + m.d * np.log(2 * np.pi)) for w, c in zip(m.weights, m.covs)]
    means, d = m.means, m.d

    @F.pandas_udf("array<double>")
    def joint(rows: pd.Series) -> pd.Series:
        x = np.vstack(rows.to_numpy()).reshape(-1, d) if len(rows) else np.zeros((0, d))
        forms = [c - 0.5 * np.einsum("ni,ij,nj->n", x - mean, v, x - mean, optimize=True) for c, v, mean in zip(constants, inverses, means)]
        return pd.Series(list(np.stack(forms, axis=1)))

    return joint(x.cast("array<double>"))


def _given_is_likeliest(rows, models):
    """``(k, row_id, likeliest)``: no component of the model gives the row a higher density than its label's.

    The densities are worked out in columns from the inverse covariances; all models are read off one scan.
    """
    out = rows.select("row_id", "x", "features")
    for k, m in models.items():
        out = clustering.add_label(out, m, label=f"label_{k}")
        out = out.withColumn(f"joint_{k}", _log_joint(m, F.col("x")))
    tests = [
        F.struct(F.lit(k).cast("long").alias("k"), (F.get(f"joint_{k}", F.col(f"label_{k}")) >= F.array_max(f"joint_{k}") - 1e-6).alias("likeliest")) for k in models
    ]
    return out.select("row_id", F.explode(F.array(*tests)).alias("t")).select("t.k", "row_id", "t.likeliest")


@query("SELECT k, vec_id AS row_id, true AS likeliest FROM embeddings, (SELECT unnest(range(2, 7)) AS k)")
def gmm_diagonal_sweep(spark, folder):
    """Diagonal mixtures of all 64 coordinates, trained on one part: every row has its likeliest component."""
    rows = _learnable(spark, folder)
    train, _ = clustering.train_test(rows)
    return _given_is_likeliest(rows, clustering.gmm_sweep(train))


@query(with_(_TEST) + "SELECT k, row_id, true AS likeliest FROM test, (SELECT unnest(range(2, 7)) AS k)")
def gmm_full_test_labels(spark, folder):
    """Full mixtures of all 64 coordinates; held-out rows have their likeliest component."""
    train, test = clustering.train_test(_learnable(spark, folder))
    return _given_is_likeliest(test, clustering.gmm_sweep(train, covariance="full"))


def _dbscan_sql(points: str, gap: str, eps: float, min_points: int = 5) -> str:
    """DBSCAN of ``points (row_id, x)`` through the reachability closure of distinct points; ``gap`` is the squared distance."""
    return f"""WITH RECURSIVE p AS ({points}),
q AS (SELECT x, count(*) AS w, min(row_id) AS id FROM p GROUP BY x),
near AS (SELECT a.id AS a, b.id AS b, b.w FROM q a, q b WHERE {gap} <= {eps}::DOUBLE * {eps}::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY a HAVING sum(w) >= {min_points}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
named AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM root),
found AS (SELECT a AS id, min(label) AS label FROM near JOIN named ON b = named.id GROUP BY a),
final AS (SELECT q.*, CAST(coalesce(n.label, f.label, -1) AS INTEGER) AS label FROM q LEFT JOIN named n ON q.id = n.id
  LEFT JOIN found f ON q.id = f.id)
SELECT p.row_id, label FROM p JOIN final USING (x)"""


_PLANE_GAP = "(a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2])"
_WIDE_GAP = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PLANE = "SELECT vec_id AS row_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS x FROM embeddings"
_WIDE = "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
_ORDERS = """SELECT o_orderkey AS row_id, [floor(o_totalprice / 1000) / 500,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) / 5] AS x FROM orders"""
# Balance and orders of a customer, and a 0/1 column for each nation.
_PROFILES = """SELECT c_custkey AS row_id, list_concat([CAST(c_acctbal AS DOUBLE) / 10000, coalesce(n, 0) / 40],
  list_transform(range(25), lambda i: CASE WHEN c_nationkey = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS x
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
PLANE_EPS, WIDE_EPS, PROFILE_EPS = 0.02, 1.2, 0.06


def _all_coordinates(spark, folder):
    return vectors(spark, folder).select("row_id", "label", "x")


@query(_dbscan_sql(_WIDE, _WIDE_GAP, WIDE_EPS))
def density_clusters(spark, folder):
    """Density clusters of all 64 coordinates."""
    return dbscan.dbscan(_all_coordinates(spark, folder), eps=WIDE_EPS)


@query(_dbscan_sql(_PLANE, _PLANE_GAP, PLANE_EPS))
def density_clusters_in_plane(spark, folder):
    return dbscan.dbscan(plane_points(spark, folder, "e0", "e1"), eps=PLANE_EPS)


@query(_dbscan_sql(_PROFILES, _WIDE_GAP, PROFILE_EPS))
def density_clusters_with_dummies(spark, folder):
    """Customers by two numbers and 25 columns of 0 and 1, which any two neighbours share."""
    bought = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, folder, "customer").join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
    dummies = [F.when(F.col("c_nationkey") == i, 1.0).otherwise(0.0) for i in range(25)]
    x = F.array(F.col("c_acctbal").cast("double") / 10000, F.coalesce("n", F.lit(0)) / 40, *dummies)
    return dbscan.dbscan(rows.select(F.col("c_custkey").alias("row_id"), x.alias("x")), eps=PROFILE_EPS)


def _order_points(spark, folder):
    """Every order as a point on a coarse lattice: few distinct points with many copies."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.array(
            F.floor(F.col("o_totalprice") / 1000) / 500,
            F.substring("o_orderpriority", 1, 1).cast("int") / 5,
        ).alias("x"),
    )


@query(_dbscan_sql(_ORDERS, _PLANE_GAP, 0.0021, 20))
def density_clusters_of_copies(spark, folder):
    return dbscan.dbscan(_order_points(spark, folder), eps=0.0021, min_points=20)


@query(f"WITH p AS ({_WIDE}) SELECT a.row_id, count(*) AS near FROM p a, p b WHERE {_WIDE_GAP} <= {WIDE_EPS}::DOUBLE * {WIDE_EPS}::DOUBLE GROUP BY a.row_id")
def neighbours_within_eps(spark, folder):
    """Neighbours of every embedding over all 64 coordinates."""
    return dbscan.neighbour_counts(_all_coordinates(spark, folder), eps=WIDE_EPS)


@query(f"WITH p AS ({_PLANE}) SELECT a.row_id, count(*) AS near FROM p a, p b WHERE {_PLANE_GAP} <= {PLANE_EPS}::DOUBLE * {PLANE_EPS}::DOUBLE GROUP BY a.row_id")
def neighbours_in_plane(spark, folder):
    return dbscan.neighbour_counts(plane_points(spark, folder, "e0", "e1"), eps=PLANE_EPS)


@query(
    """WITH long_ AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, -1 AS i, -1 AS j, CAST(count(*) AS DOUBLE) AS s FROM embeddings GROUP BY label
UNION ALL SELECT label, CAST(i AS INTEGER), -1, round(sum(v), 6) FROM long_ GROUP BY label, i
UNION ALL SELECT a.label, CAST(a.i AS INTEGER), CAST(b.i AS INTEGER), round(sum(a.v * b.v), 6) FROM long_ a JOIN long_ b ON a.vec_id = b.vec_id AND a.i <= b.i
  GROUP BY a.label, a.i, b.i"""
)
def cluster_moments(spark, folder):
    """Counts, sums and sums of products of all 64 coordinates per label."""
    sums = selection.cluster_moments(vectors(spark, folder), [f"e{i}" for i in range(64)])
    return rounded(sums.withColumn("label", F.col("label").cast("int")), "s")


MOMENTS = """m AS (SELECT label, count(*) AS n, avg(e0) AS m0, avg(e1) AS m1, count(*) / sum(count(*)) OVER () AS w,
  var_pop(e0) AS c00, covar_pop(e0, e1) AS c01, var_pop(e1) AS c11, var_samp(e0) AS s00,
  covar_samp(e0, e1) AS s01, var_samp(e1) AS s11 FROM e GROUP BY label)"""


@query(
    with_(
        E,
        MOMENTS,
        """sw AS (SELECT sum(w * s00) AS a, sum(w * s01) AS b, sum(w * s11) AS c, sum(w * m0) AS g0, sum(w * m1) AS g1 FROM m),
sb AS (SELECT sum(w * (m0 - g0) * (m0 - g0)) AS p, sum(w * (m0 - g0) * (m1 - g1)) AS q, sum(w * (m1 - g1) * (m1 - g1)) AS r FROM m, sw)""",
    )
    + "SELECT round((c * p - 2 * b * q + a * r) / (a * c - b * b), 6) AS score FROM sw, sb"
)
def scatter_criterion(spark, folder):
    score = selection.scatter_criterion(vectors(spark, folder), ["e0", "e1"])
    return rounded(spark.createDataFrame([(score,)], "score double"), "score")


def _label_mixture(spark, folder, *columns):
    """Mixture whose components have the moments of the labels."""
    rows = plane_points(spark, folder, *columns)
    mixture, _ = mx.weighted_moments(rows, None, label="label", k=10, target="x", target_d=len(columns))
    return rows, mixture


# A diagonal mixture with the moments of the labels, over the 64 coordinates as rows (row_id, label, i, v).
LONG = "long_ AS (SELECT vec_id AS row_id, label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
DIAGONAL = """share AS (SELECT label AS j, count(*) / sum(count(*)) OVER () AS w FROM embeddings GROUP BY label),
entry AS (SELECT label AS j, i, avg(v) AS m, var_pop(v) AS s FROM long_ GROUP BY label, i),
forms AS (SELECT row_id, j, sum(-0.5 * ((v - m) * (v - m) / s + ln(2 * pi() * s))) AS f FROM long_ JOIN entry USING (i) GROUP BY row_id, j),
joint AS (SELECT row_id, j, f + ln(w) AS p FROM forms JOIN share USING (j)),
total AS (SELECT row_id, max(p) + ln(sum(exp(p - t))) AS p FROM (SELECT *, max(p) OVER (PARTITION BY row_id) AS t FROM joint) GROUP BY row_id)"""


def _diagonal_mixture(spark, folder):
    rows = vectors(spark, folder).select("row_id", "label", "x")
    return rows, mx.weighted_moments(rows, None, label="label", k=10, target="x", target_d=64, diagonal=True)[0]


@query(with_(LONG, DIAGONAL) + "SELECT round(sum(p), 3) AS log_likelihood, round(2 * sum(p) - (10 * 64 + 10 * 64 + 9) * ln(count(*)), 3) AS score FROM total")
def likelihood_criterion(spark, folder):
    """Likelihood of all 64 coordinates under the diagonal mixture of the labels, and its criterion."""
    rows, mixture = _diagonal_mixture(spark, folder)
    total = mx.log_likelihoods(rows, [mixture])[0]
    score = 2 * total - mixture.parameters(diagonal=True) * float(np.log(rows.count()))
    out = spark.createDataFrame([(total, score)], "log_likelihood double, score double")
    return rounded(out, "log_likelihood", "score", places=3)


@query(with_(LONG, DIAGONAL) + "SELECT row_id, arg_max(j, p) AS component FROM joint GROUP BY row_id")
def mixture_assignment(spark, folder):
    rows, mixture = _diagonal_mixture(spark, folder)
    return mx.assign(rows, mixture, label="component").select("row_id", "component")


PAIRS = """ij AS (SELECT a.label AS i, b.label AS j, a.w AS wi, b.w AS wj, a.w + b.w AS w,
  (a.w * a.m0 + b.w * b.m0) / (a.w + b.w) AS m0, (a.w * a.m1 + b.w * b.m1) / (a.w + b.w) AS m1,
  a.c00 * a.c11 - a.c01 * a.c01 AS di, b.c00 * b.c11 - b.c01 * b.c01 AS dj,
  (a.w * a.c00 + b.w * b.c00) / (a.w + b.w) + a.w * b.w * (a.m0 - b.m0) * (a.m0 - b.m0) / ((a.w + b.w) * (a.w + b.w)) AS c00,
  (a.w * a.c01 + b.w * b.c01) / (a.w + b.w) + a.w * b.w * (a.m0 - b.m0) * (a.m1 - b.m1) / ((a.w + b.w) * (a.w + b.w)) AS c01,
  (a.w * a.c11 + b.w * b.c11) / (a.w + b.w) + a.w * b.w * (a.m1 - b.m1) * (a.m1 - b.m1) / ((a.w + b.w) * (a.w + b.w)) AS c11
  FROM m a JOIN m b ON a.label < b.label),
costs AS (SELECT *, wi * ln((c00 * c11 - c01 * c01) / di) + wj * ln((c00 * c11 - c01 * c01) / dj) AS cost FROM ij),
closest AS (SELECT * FROM costs ORDER BY cost, j DESC, i DESC LIMIT 1)"""

_MERGED_COLUMNS = "weight double, m0 double, m1 double, c00 double, c01 double, c11 double"


def _mixture_table(spark, m):
    rows = [
        (i, *(float(v) for v in (m.weights[i], *m.means[i], m.covs[i, 0, 0], m.covs[i, 0, 1], m.covs[i, 1, 1])))
        for i in range(m.k)
    ]
    out = spark.createDataFrame(rows, "component int, " + _MERGED_COLUMNS)
    return rounded(out, "weight", "m0", "m1", "c00", "c01", "c11")


@query(
    with_(E, MOMENTS, PAIRS)
    + "SELECT i, j, round(w, 6) AS weight, round(m0, 6) AS m0, round(m1, 6) AS m1, round(c00, 6) AS c00, round(c01, 6) AS c01, round(c11, 6) AS c11 FROM closest"
)
def closest_components(spark, folder):
    _, mixture = _label_mixture(spark, folder, "e0", "e1")
    i, j, m = mx.closest_pair(mixture)
    row = (i, j, *(float(v) for v in (m.weights[0], *m.means[0], m.covs[0, 0, 0], m.covs[0, 0, 1], m.covs[0, 1, 1])))
    out = spark.createDataFrame([row], "i int, j int, " + _MERGED_COLUMNS)
    return rounded(out, "weight", "m0", "m1", "c00", "c01", "c11")


@query(
    with_(E, MOMENTS, PAIRS)
    + """SELECT CAST(row_number() OVER (ORDER BY last, label) - 1 AS INTEGER) AS component, round(w, 6) AS weight,
  round(m0, 6) AS m0, round(m1, 6) AS m1, round(c00, 6) AS c00, round(c01, 6) AS c01, round(c11, 6) AS c11 FROM (
  SELECT 0 AS last, label, w, m0, m1, c00, c01, c11 FROM m WHERE label NOT IN (SELECT i FROM closest UNION ALL SELECT j FROM closest)
  UNION ALL SELECT 1, 0, w, m0, m1, c00, c01, c11 FROM closest)"""
)
def merged_components(spark, folder):
    _, mixture = _label_mixture(spark, folder, "e0", "e1")
    m = mx.merge_closest(mixture)
    return _mixture_table(spark, m)


@query(
    with_(
        E,
        MOMENTS,
        "dens AS (SELECT row_id, e1, e2, m.label AS j, w * exp(-0.5 * (e0 - m0) * (e0 - m0) / c00) / sqrt(c00) AS p FROM e, m)",
        "resp AS (SELECT j, e1, e2, p / sum(p) OVER (PARTITION BY row_id) AS r FROM dens)",
        "mu AS (SELECT j, sum(r) AS n, sum(r * e1) / sum(r) AS m0, sum(r * e2) / sum(r) AS m1 FROM resp GROUP BY j)",
    )
    + """SELECT resp.j AS component, round(any_value(n) / (SELECT count(*) FROM e), 6) AS weight, round(any_value(m0), 6) AS m0,
  round(any_value(m1), 6) AS m1, round(sum(r * (e1 - m0) * (e1 - m0)) / any_value(n) + 1e-6, 6) AS c00,
  round(sum(r * (e1 - m0) * (e2 - m1)) / any_value(n), 6) AS c01, round(sum(r * (e2 - m1) * (e2 - m1)) / any_value(n) + 1e-6, 6) AS c11
  FROM resp JOIN mu ON resp.j = mu.j GROUP BY resp.j"""
)
def cross_projected_mixture(spark, folder):
    """Responsibilities from one column, weighted moments of two others."""
    _, mixture = _label_mixture(spark, folder, "e0")
    found = selection.Clustering(("e0",), mixture.k, 0.0, mixture)
    m = selection.cross_mixture(vectors(spark, folder), found, ["e1", "e2"])
    return _mixture_table(spark, m)


def _entries(spark, m):
    """``(component, i, weight, mean, variance)`` of a diagonal mixture."""
    rows = [(j, i, float(m.weights[j]), float(m.means[j, i]), float(m.covs[j, i, i])) for j in range(m.k) for i in range(m.d)]
    return rounded(spark.createDataFrame(rows, "component int, i int, weight double, mean double, variance double"), "weight", "mean", "variance")


@query(
    with_(LONG, DIAGONAL, "resp AS (SELECT row_id, j, exp(joint.p - total.p) AS r FROM joint JOIN total USING (row_id))", "size AS (SELECT j, sum(r) AS n FROM resp GROUP BY j)",
          "mu AS (SELECT j, i, sum(r * v) / sum(r) AS a FROM resp JOIN long_ USING (row_id) GROUP BY j, i)")
    + """SELECT resp.j AS component, CAST(long_.i AS INTEGER) AS i, round(any_value(n) / (SELECT count(*) FROM embeddings), 6) AS weight, round(any_value(a), 6) AS mean,
  round(sum(r * (v - a) * (v - a)) / any_value(n), 6) AS variance FROM resp JOIN long_ USING (row_id) JOIN mu ON resp.j = mu.j AND long_.i = mu.i JOIN size ON resp.j = size.j GROUP BY resp.j, long_.i"""
)
def gmm_diagonal_step(spark, folder):
    """One round of expectation-maximisation over all 64 coordinates, started from the moments of the labels."""
    rows, start = _diagonal_mixture(spark, folder)
    return _entries(spark, mx.weighted_moments(rows, start, target="x", target_d=64, diagonal=True)[0])


# Numeric profile of every customer: all numeric columns of the table and two sums over the orders.
COLUMNS = ("acctbal", "nation", "orders", "spent")


def profiles(spark, folder):
    """``(row_id, COLUMNS)`` of all customers."""
    bought = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    rows = table(spark, folder, "customer").join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_acctbal").cast("double").alias("acctbal"),
        F.col("c_nationkey").cast("double").alias("nation"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("orders", "spent")],
    )


def _standard(spark, folder):
    """The standardised profile and its row count, stored."""
    data = materialize(z_score(profiles(spark, folder), COLUMNS))
    return data, data.count()


def _score_of_labels(data, rows, found, criterion):
    """The score of a clustering again, from the labels or densities it gives every row."""
    if criterion == "ML":
        m = found.model
        joint = data.select(_log_joint(m, F.array(*[F.col(c) for c in found.columns])).alias("j"))
        top = F.array_max("j")
        one = top + F.log(F.aggregate("j", F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
        return 2 * joint.agg(F.sum(one)).first()[0] - m.parameters() * np.log(rows)
    labelled = found.labelled(data)
    columns = list(found.columns)
    mean = labelled.agg(*[F.avg(c) for c in columns]).first()
    inside, between = np.zeros((len(columns),) * 2), np.zeros((len(columns),) * 2)
    aggs = [F.avg(c) for c in columns] + [F.covar_samp(a, b) for a in columns for b in columns]
    for r in labelled.groupBy("label").agg(F.count(F.lit(1)), *aggs).collect():
        share, off = r[1] / rows, np.array(r[2 : 2 + len(columns)]) - np.array(mean)
        if r[1] > 1:
            inside += share * np.array(r[2 + len(columns) :]).reshape(inside.shape)
        between += share * np.outer(off, off)
    return float(np.trace(np.linalg.pinv(inside) @ between)) if found.clusters > 1 else 0.0


def _holds(data, rows, found, criterion):
    """Whether the number of clusters is in range and the score is that of the labels."""
    again = _score_of_labels(data, rows, found, criterion)
    return 1 <= found.clusters <= selection.max_clusters(rows) and bool(np.isclose(found.score, again, rtol=1e-6, atol=1e-6))


def _outcome(spark, rows, names="columns string, score_holds boolean"):
    return spark.createDataFrame(rows, names)


@query("SELECT 'acctbal,nation,orders,spent' AS columns, true AS score_holds")
def em_clustering(spark, folder):
    data, rows = _standard(spark, folder)
    found = selection.em_clustering(data, COLUMNS)
    return _outcome(spark, [(",".join(found.columns), _holds(data, rows, found, "ML"))])


@query("SELECT 'acctbal,nation,orders,spent' AS columns, true AS score_holds")
def km_clustering(spark, folder):
    data, rows = _standard(spark, folder)
    found = selection.km_clustering(data, COLUMNS)
    return _outcome(spark, [(",".join(found.columns), _holds(data, rows, found, "SS"))])


@query("SELECT true AS score_holds, true AS best")
def forward_step(spark, folder):
    """The step from one chosen column: no other column to add scores higher."""
    data, rows = _standard(spark, folder)
    scans = selection.scans_of(data, COLUMNS)
    cluster = lambda subsets: selection.km_clusterings(scans, COLUMNS, subsets)
    best = selection.forward_step(COLUMNS, ["orders"], cluster)
    others = cluster([[c for c in COLUMNS if c in ("orders", new)] for new in COLUMNS if new != "orders"])
    fits = best.columns in [o.columns for o in others] and all(best.score >= o.score for o in others)
    return _outcome(spark, [(_holds(data, rows, best, "SS"), fits)], "score_holds boolean, best boolean")


def _searched(spark, folder, search, criterion):
    """Priorities 1..m of the chosen columns, 0 of the others, and the score of the clustering of those."""
    data, rows = _standard(spark, folder)
    found = search(data)
    chosen = sorted(p for p in found.priority.values() if p)
    ranked = chosen == list(range(1, len(chosen) + 1)) and {c for c, p in found.priority.items() if p} == set(found.columns)
    holds = _holds(data, rows, found.clustering, criterion)
    return _outcome(spark, [(c, ranked, holds) for c in found.priority], "feature string, ranked boolean, score_holds boolean")


_SEARCHED = "SELECT unnest(['acctbal', 'nation', 'orders', 'spent']) AS feature, true AS ranked, true AS score_holds"


@query(_SEARCHED)
def feature_selection_em(spark, folder):
    return _searched(spark, folder, lambda data: selection.select_em(data, COLUMNS), "ML")


@query(_SEARCHED)
def feature_selection_em_scatter(spark, folder):
    return _searched(spark, folder, lambda data: selection.select_em(data, COLUMNS, criterion="SS"), "SS")


@query(_SEARCHED)
def feature_selection_km(spark, folder):
    return _searched(spark, folder, lambda data: selection.select_km(data, COLUMNS), "SS")


# The searches over all 64 embedding coordinates: fitted models have no SQL, tests recheck scores from labels.
WIDE_COLUMNS = [f"e{i}" for i in range(64)]


def _wide_standard(spark, folder):
    return materialize(z_score(vectors(spark, folder).select("row_id", *WIDE_COLUMNS), WIDE_COLUMNS))


def _as_rows(spark, *found):
    rows = [(",".join(f.columns), f.clusters, float(f.score)) for f in found]
    return spark.createDataFrame(rows, "columns string, clusters int, score double")


@query()
def em_clustering_of_embeddings(spark, folder):
    """Number of components and score of a full mixture of 64 coordinates."""
    return _as_rows(spark, selection.em_clustering(_wide_standard(spark, folder), WIDE_COLUMNS))


@query()
def km_clustering_of_embeddings(spark, folder):
    return _as_rows(spark, selection.km_clustering(_wide_standard(spark, folder), WIDE_COLUMNS))


@query()
def forward_step_of_embeddings(spark, folder):
    """The score of every coordinate as the first of a search, 64 candidates in shared passes."""
    scans = selection.scans_of(_wide_standard(spark, folder), WIDE_COLUMNS)
    return _as_rows(spark, *selection.km_clusterings(scans, WIDE_COLUMNS, [[c] for c in WIDE_COLUMNS]))


@query()
def feature_selection_em_of_embeddings(spark, folder):
    rows = vectors(spark, folder)
    return selection.priorities(rows, selection.select_em(rows, WIDE_COLUMNS))


@query()
def feature_selection_em_scatter_of_embeddings(spark, folder):
    rows = vectors(spark, folder)
    return selection.priorities(rows, selection.select_em(rows, WIDE_COLUMNS, criterion="SS"))


@query()
def feature_selection_km_of_embeddings(spark, folder):
    rows = vectors(spark, folder)
    return selection.priorities(rows, selection.select_km(rows, WIDE_COLUMNS))


@query()
def scatter_of_embeddings(spark, folder):
    """The scatter of the labels over all 64 coordinates."""
    rows = vectors(spark, folder)
    return rounded(spark.createDataFrame([(selection.scatter_criterion(rows, WIDE_COLUMNS),)], "score double"), "score")


def _full_entries(spark, m):
    """``(component, i, j, weight, mean, covariance)`` of a full mixture, i <= j."""
    rows = [(c, i, j, float(m.weights[c]), float(m.means[c, i]), float(m.covs[c, i, j])) for c in range(m.k) for i in range(m.d) for j in range(i, m.d)]
    return rounded(spark.createDataFrame(rows, "component int, i int, j int, weight double, mean double, covariance double"), "weight", "mean", "covariance")


@query()
def merged_components_of_embeddings(spark, folder):
    """The full mixture of the labels over 64 coordinates with its closest pair merged."""
    return _full_entries(spark, mx.merge_closest(_label_mixture(spark, folder, *WIDE_COLUMNS)[1]))


@query()
def cross_projected_mixture_of_embeddings(spark, folder):
    """Responsibilities from the first 32 coordinates, weighted moments of the other 32."""
    _, mixture = _label_mixture(spark, folder, *WIDE_COLUMNS[:32])
    found = selection.Clustering(tuple(WIDE_COLUMNS[:32]), mixture.k, 0.0, mixture)
    return _full_entries(spark, selection.cross_mixture(vectors(spark, folder), found, WIDE_COLUMNS[32:]))
