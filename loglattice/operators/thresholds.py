"""Flagging scored rows at several thresholds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag(
    scores: DataFrame, eps: Sequence[float], *, score: str = "score", low_is_anomalous: bool = False
) -> DataFrame:
    """One row per scored row and threshold, with ``eps`` and ``is_anomaly``.

    A score above the threshold is an anomaly, or one below it with ``low_is_anomalous``.
    """
    levels = F.array(*[F.lit(float(e)) for e in eps])
    out = scores.withColumn("eps", F.explode(levels))
    hit = F.col(score) < F.col("eps") if low_is_anomalous else F.col(score) > F.col("eps")
    return out.withColumn("is_anomaly", hit)
