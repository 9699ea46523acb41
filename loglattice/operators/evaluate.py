"""Quality of flags against known labels (1 anomaly, 0 normal)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(flagged: Column, truth: Column) -> dict[str, Column]:
    hit = F.coalesce(flagged, F.lit(False))
    return {
        "tn": F.count_if(~hit & (truth == 0)),
        "fn": F.count_if(~hit & (truth == 1)),
        "fp": F.count_if(hit & (truth == 0)),
        "tp": F.count_if(hit & (truth == 1)),
    }


def balanced_f(
    flags: DataFrame, *, flag: str = "is_anomaly", truth: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Counts, accuracy ``r1`` on normals and ``r2`` on anomalies, and ``f`` = 2 r1 r2 / (r1 + r2).

    ``f`` is 0 where both accuracies are 0.
    """
    cells = _cells(F.col(flag), F.col(truth))
    out = flags.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])
    out = out.withColumns(
        {
            "r1": F.try_divide("tn", F.col("tn") + F.col("fp")),
            "r2": F.try_divide("tp", F.col("tp") + F.col("fn")),
        }
    )
    r1, r2 = F.col("r1"), F.col("r2")
    f = F.when(r1 + r2 == 0, F.lit(0.0)).otherwise(F.try_divide(2 * r1 * r2, r1 + r2))
    return out.withColumn("f", f)


def detection_rates(
    flags: DataFrame, *, flag: str = "is_anomaly", truth: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Counts, detection rate ``dr`` = tp / (tp + fn) and false positive rate ``fpr``."""
    cells = _cells(F.col(flag), F.col(truth))
    return (
        flags.groupBy(*by)
        .agg(*[cells[n].alias(n) for n in ("tp", "fp", "fn", "tn")])
        .withColumns(
            {
                "dr": F.try_divide("tp", F.col("tp") + F.col("fn")),
                "fpr": F.try_divide("fp", F.col("fp") + F.col("tn")),
            }
        )
    )
