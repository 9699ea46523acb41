"""Column scaling from one global aggregate, and reproducible jitter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.fields import uniform


def _with_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Attach one struct of global aggregates as a scalar subquery."""
    one = df.agg(*[c.alias(n) for n, c in stats.items()])
    packed = one.select(F.struct(*one.columns).alias("s"))
    return df.withColumn("__stats", packed.scalar())


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``columns`` to [0, 1]; a constant column becomes 0."""
    stats = {f"lo{i}": F.min(c) for i, c in enumerate(columns)}
    stats |= {f"hi{i}": F.max(c) for i, c in enumerate(columns)}
    s = F.col("__stats")
    scaled = {}
    for i, c in enumerate(columns):
        low, high = s[f"lo{i}"], s[f"hi{i}"]
        ratio = (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))
        scaled[c] = F.when(F.col(c).isNotNull(), F.coalesce(ratio, F.lit(0.0)))
    return _with_stats(df, columns, stats).withColumns(scaled).drop("__stats")


def z_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre ``columns`` and divide by the population deviation; a constant column becomes 0."""
    stats = {f"mu{i}": F.avg(c) for i, c in enumerate(columns)}
    stats |= {f"sd{i}": F.stddev_pop(c) for i, c in enumerate(columns)}
    s = F.col("__stats")
    scaled = {}
    for i, c in enumerate(columns):
        ratio = (F.col(c) - s[f"mu{i}"]) / F.nullif(s[f"sd{i}"], F.lit(0.0))
        scaled[c] = F.when(F.col(c).isNotNull(), F.coalesce(ratio, F.lit(0.0)))
    return _with_stats(df, columns, stats).withColumns(scaled).drop("__stats")


def jitter(
    df: DataFrame, columns: Sequence[str], *, row_id: str = "row_id", seed: int = 0
) -> DataFrame:
    """Add uniform noise in [-0.5, 0.5) that depends on the row id, the column and the seed."""
    return df.withColumns(
        {c: F.col(c) + uniform(F.col(row_id), seed, i) - 0.5 for i, c in enumerate(columns)}
    )
