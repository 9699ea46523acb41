"""Clustering of the input table: train/test split, k-means and Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.fields import split_bucket
from loglattice.operators import batched
from loglattice.operators import mixture as mx

# The default sweep tries 2 to 6 clusters.
DEFAULT_K = range(2, 7)


def with_split(df: DataFrame, *, row_id: str = "row_id", seed: int = 4, folds: int = 10) -> DataFrame:
    """Add ``is_test``, true for one row in ``folds``, fixed by the row id."""
    return df.withColumn("is_test", split_bucket(F.col(row_id), seed, folds) == 0)


def train_test(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, **options)
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def with_vector(df: DataFrame, array: str, vector: str = "features") -> DataFrame:
    return df.withColumn(vector, array_to_vector(F.col(array).cast("array<double>")))


def _sweep(fit, ks: Iterable[int], threads: int) -> dict:
    """Fits for several k share the stored input; their jobs interleave on the cluster."""
    with ThreadPoolExecutor(threads) as pool:
        jobs = {k: pool.submit(fit, k) for k in ks}
        return {k: job.result() for k, job in jobs.items()}


def kmeans_sweep(
    df: DataFrame, ks: Iterable[int] = DEFAULT_K, *, features: str = "features", seed: int = 0,
    max_iter: int = 100, tol: float = 1e-4, threads: int = 4,
) -> dict[int, KMeansModel]:
    """One k-means model per k.

    The table given to a fit is not itself cached: Spark then keeps the vectors and their norms as objects, where a
    cached table would be decoded again in every iteration. Several fits share one cached input below that.
    """
    ks, data = list(ks), df.select(features)
    if len(ks) > 1:
        data = data.persist()
    try:
        return _sweep(
            lambda k: KMeans(k=k, seed=seed, featuresCol=features, maxIter=max_iter, tol=tol).fit(data.select(features, F.lit(k).alias("k"))), ks, threads
        )
    finally:
        if len(ks) > 1:
            data.unpersist()


def gmm_sweep(
    df: DataFrame, ks: Iterable[int] = DEFAULT_K, *, covariance: str = "diag", features: str = "features",
    seed: int = 0, max_iter: int = 100, tol: float = 1e-3,
) -> dict[int, mx.Mixture]:
    """One Gaussian mixture per k, with ``diag`` or ``full`` covariances; each iteration of all k is one pass."""
    if covariance not in ("diag", "full"):
        raise ValueError(covariance)
    ks = list(ks)
    data = df.select(vector_to_array(features).alias("x")).persist()
    try:
        d = data.select(F.size("x").alias("d")).first()
        scans = batched.Scans(data, d["d"] if d else 0)
        every = tuple(range(scans.d))
        fits = batched.gmm_fits(scans, [(every, k) for k in ks], diagonal=covariance == "diag", seed=seed, max_iter=max_iter, tol=tol)
        return dict(zip(ks, map(scans.moved_back, fits)))
    finally:
        data.unpersist()


def predict(df: DataFrame, models: Mapping[int, KMeansModel | mx.Mixture], *, row_id: str = "row_id", features: str = "features") -> DataFrame:
    """``(k, row_id, label)`` for every model, from one scan of ``df``."""
    out = df.select(row_id, features, vector_to_array(features).alias("x"))
    for k, model in models.items():
        if isinstance(model, mx.Mixture):
            out = mx.assign(out, model, "x", f"label_{k}")
        else:
            out = model.copy({model.predictionCol: f"label_{k}", model.featuresCol: features}).transform(out)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"label_{k}").alias("label")) for k in models])
    return out.select(row_id, F.explode(pairs).alias("p")).select("p.k", row_id, "p.label")


def add_label(df: DataFrame, model: KMeansModel | mx.Mixture, features: str = "features", label: str = "label") -> DataFrame:
    """``df`` with the cluster of every row; no row moves."""
    if isinstance(model, mx.Mixture):
        return mx.assign(df.withColumn("__x", vector_to_array(features)), model, "__x", label).drop("__x")
    return model.copy({model.predictionCol: label, model.featuresCol: features}).transform(df)


def fit_predict(df: DataFrame, ks: Iterable[int] = DEFAULT_K, **options) -> DataFrame:
    """Train k-means on all rows and label the same rows: ``(k, row_id, label)``."""
    row_id = options.pop("row_id", "row_id")
    features = options.get("features", "features")
    return predict(df, kmeans_sweep(df, ks, **options), row_id=row_id, features=features)


def label_sizes(labels: DataFrame, ks: Iterable[int] | None = None) -> DataFrame:
    """Rows per label; with ``ks`` (for a table with a ``k`` column) empty clusters count 0."""
    by = [c for c in ("k", "label") if c in labels.columns]
    sizes = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if ks is None:
        return sizes
    grid = labels.sparkSession.createDataFrame([(k, i) for k in ks for i in range(k)], "k int, label int")
    return grid.join(sizes, ["k", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def centers_of(model: KMeansModel | mx.Mixture, df: DataFrame) -> DataFrame:
    """``(center, c)``: the centre of each cluster as an array."""
    points = model.means if isinstance(model, mx.Mixture) else model.clusterCenters()
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(points)]
    return df.sparkSession.createDataFrame(rows, "center int, c array<double>")


def _with_distances(df: DataFrame, centers: DataFrame, features: str) -> DataFrame:
    """Add ``__d``, the distances to all centres as an array of (distance, center).

    The centres arrive as one scalar subquery, so no row is joined.
    """
    packed = centers.agg(F.array_sort(F.collect_list(F.struct("center", "c"))).alias("cs"))
    x = F.col(features).cast("array<double>")

    def one(entry: Column) -> Column:
        squares = F.zip_with(x, entry.getField("c"), lambda u, v: (u - v) * (u - v))
        total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
        return F.struct(F.sqrt(total).alias("distance"), entry.getField("center").alias("center"))

    return df.withColumn("__cs", packed.scalar()).withColumn("__d", F.transform("__cs", one))


def center_distances(df: DataFrame, centers: DataFrame, *, row_id: str = "row_id", features: str = "x") -> DataFrame:
    """``(row_id, center, distance)``: Euclidean distance of every row to every centre."""
    far = _with_distances(df, centers, features)
    return far.select(row_id, F.explode("__d").alias("d")).select(row_id, "d.center", "d.distance")


def nearest_center(df: DataFrame, centers: DataFrame, *, row_id: str = "row_id", features: str = "x") -> DataFrame:
    """``(row_id, label, distance)``; of equally near centres the first counts."""
    best = _with_distances(df, centers, features).select(row_id, F.array_min("__d").alias("d"))
    return best.select(row_id, F.col("d.center").alias("label"), "d.distance")
