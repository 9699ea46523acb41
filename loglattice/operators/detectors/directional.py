"""Direction of a sequence's transition counts against the mean direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.chi2 import chi2_quantile
from loglattice.operators.lookup import lookup
from loglattice.operators.transitions import slot_counts
from loglattice.session import materialize


def direction_vectors(sequences: DataFrame, states: int, **options) -> DataFrame:
    """``(seq_id, slot, x)`` of unit length; sequences of one position are absent."""
    counts = slot_counts(sequences, states, **options)
    n = F.col("n").cast("double")
    length = F.sqrt(F.sum(n * n).over(Window.partitionBy("seq_id")))
    return counts.select("seq_id", "slot", (n / length).alias("x"))


def mean_direction(vectors: DataFrame) -> DataFrame:
    """``(slot, m)``: the mean of the vectors, of unit length (the count cancels out)."""
    sums = vectors.groupBy("slot").agg(F.sum("x").alias("s"))
    length = F.sqrt(sums.select(F.sum(F.col("s") * F.col("s"))).scalar())
    return sums.select("slot", (F.col("s") / length).alias("m"))


def direction_scores(vectors: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    """``(seq_id, score)``: one minus the cosine to the mean direction."""
    mean = materialize(mean_direction(vectors)) if mean is None else mean
    joined = lookup(vectors, mean, ["slot"])
    cosine = F.sum(F.col("x") * F.coalesce("m", F.lit(0.0)))
    return joined.groupBy("seq_id").agg((F.lit(1.0) - cosine).alias("score"))


def threshold(states: int, kappa: float, q: float = 0.99) -> float:
    """Quantile of the chi-square law the scores follow for concentration ``kappa``."""
    return chi2_quantile(q, states * states - 1, 1 / (2 * kappa))


def estimate_kappa(scores: DataFrame, states: int) -> float:
    """Concentration by the method of moments: df / (2 * mean score)."""
    mean = scores.agg(F.avg("score").alias("m")).first()["m"]
    return (states * states - 1) / (2 * mean)


def detect(
    sequences: DataFrame, states: int, kappa: float, *, q: float = 0.99, mean: DataFrame | None = None, **options
) -> DataFrame:
    """``(seq_id, score, threshold, is_anomaly)``; ``mean`` is a stored direction of other sequences."""
    scores = direction_scores(direction_vectors(sequences, states, **options), mean)
    limit = threshold(states, kappa, q)
    return scores.withColumns(
        {"threshold": F.lit(limit), "is_anomaly": F.col("score") > F.lit(limit)}
    )
