"""Transition statistics of a sequence table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.sequences import adjacent
from loglattice.session import materialize


def transition_table(sequences: DataFrame, **options) -> DataFrame:
    """``(from_state, to_state, n, from_total, grand_total, p, pq)`` of the observed pairs.

    ``p`` is n / from_total; ``pq`` is n^2 / (from_total * grand_total). Counting combines
    on the map side, so the shuffle carries one row per pair and task.
    """
    pairs = adjacent(sequences, **options).where(F.col("to_state").isNotNull())
    counts = pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.withColumn("from_total", F.sum("n").over(Window.partitionBy("from_state")))
    grand = counts.select(F.sum("n").alias("t"))
    totals = totals.withColumn("grand_total", grand.scalar())
    n, row, all_ = (F.col(c).cast("double") for c in ("n", "from_total", "grand_total"))
    return totals.withColumns({"p": n / row, "pq": n * n / (row * all_)})


def train(sequences: DataFrame, **options) -> DataFrame:
    """The transition table, stored: it is read for its size and again for the scores."""
    return materialize(transition_table(sequences, **options))


def transition_matrix(table: DataFrame, states: list[int]) -> DataFrame:
    """Dense report: one row per state, columns ``to_<state>`` and ``total``, zeros included."""
    wide = table.groupBy("from_state").pivot("to_state", states).agg(F.sum("n"))
    base = table.sparkSession.createDataFrame([(s,) for s in states], "from_state int")
    filled = base.join(wide, "from_state", "left")
    cells = [F.coalesce(F.col(str(s)), F.lit(0)).cast("long").alias(f"to_{s}") for s in states]
    row = filled.select("from_state", *cells)
    total = sum((F.col(f"to_{s}") for s in states), F.lit(0).cast("long"))
    return row.withColumn("total", total)


def slot_counts(sequences: DataFrame, states: int, **options) -> DataFrame:
    """``(seq_id, slot, n)`` with slot = states * from + to."""
    slot = (F.col("from_state") * F.lit(states) + F.col("to_state")).cast("int")
    return (
        adjacent(sequences, **options)
        .where(F.col("to_state").isNotNull())
        .groupBy("seq_id", slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
