"""Transition frequencies of a sequence as a vector, and clusters of those vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.lookup import lookup
from loglattice.operators.transitions import slot_counts
from loglattice.session import materialize


def frequency_vectors(sequences: DataFrame, states: int, **options) -> DataFrame:
    """``(seq_id, slot, x)``: share of each transition; sequences of one position are absent."""
    counts = slot_counts(sequences, states, **options)
    whole = Window.partitionBy("seq_id")
    return counts.select("seq_id", "slot", (F.col("n") / F.sum("n").over(whole)).alias("x"))


def sparse_vectors(vectors: DataFrame, states: int) -> DataFrame:
    """``(seq_id, features VECTOR)`` of length states^2, one row per sequence, holding its transitions only."""
    cells = F.array_sort(F.collect_list(F.struct("slot", "x")))
    packed = vectors.groupBy("seq_id").agg(cells.alias("cells"))

    @F.udf(VectorUDT())
    def sparse(slots, shares):
        return Vectors.sparse(states * states, slots, shares)

    return packed.select("seq_id", sparse("cells.slot", "cells.x").alias("features"))


def flag_small_clusters(labelled: DataFrame, min_share: float = 0.1) -> DataFrame:
    """Add ``cluster_size`` and ``is_anomaly``: the cluster holds less than ``min_share`` of the rows."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("cluster_size"))
    share = F.col("cluster_size") / sizes.select(F.sum("cluster_size")).scalar()
    return lookup(labelled, materialize(sizes.withColumn("is_anomaly", share < min_share)), ["label"])


def detect(
    sequences: DataFrame,
    states: int,
    clusters: int,
    *,
    min_share: float = 0.1,
    seed: int = 0,
    **options,
) -> DataFrame:
    """``(seq_id, label, cluster_size, is_anomaly)``: members of small clusters are anomalies."""
    data = materialize(sparse_vectors(frequency_vectors(sequences, states, **options), states))
    model = KMeans(k=clusters, seed=seed).fit(data)
    labelled = model.transform(data).select("seq_id", F.col("prediction").alias("label"))
    return flag_small_clusters(labelled, min_share).select("seq_id", "label", "cluster_size", "is_anomaly")
