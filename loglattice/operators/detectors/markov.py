"""Surprise of a sequence under the first-order transition probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.lookup import lookup
from loglattice.operators.sequences import adjacent
from loglattice.operators.thresholds import flag
from loglattice.operators.transitions import train
from loglattice.session import materialize


def markov_scores(
    sequences: DataFrame,
    table: DataFrame | None = None,
    *,
    alpha: float = 0.0,
    states: int | None = None,
    **options,
) -> DataFrame:
    """``(seq_id, score)``: the mean of -log2 P over the transitions of a sequence.

    ``table``: a stored transition table of other (training) sequences; by default that of
    ``sequences``. A sequence of one position scores 0. A transition the table has not seen
    gives +Infinity, or with ``alpha`` > 0 the add-alpha estimate over ``states`` states.
    ``options`` (``rows_per_block``, ``max_length``) are those of ``adjacent``.
    """
    if table is None:
        table = train(sequences, **options)
    moves = adjacent(sequences, **options)
    moves = lookup(moves, table.select("from_state", "to_state", "n", "p"), ["from_state", "to_state"])
    p = F.col("p")
    if alpha > 0:
        if states is None:
            raise ValueError("alpha smoothing needs the number of states")
        rows = materialize(table.select("from_state", "from_total").distinct())
        moves = lookup(moves, rows, ["from_state"])
        seen = F.coalesce(F.col("n"), F.lit(0)) + F.lit(alpha)
        p = seen / (F.coalesce(F.col("from_total"), F.lit(0)) + F.lit(alpha * states))
    surprise = F.when(p > 0, -F.log2(p)).otherwise(F.lit(float("inf")))
    surprise = F.when(F.col("to_state").isNotNull(), surprise)
    return moves.groupBy("seq_id").agg(F.coalesce(F.avg(surprise), F.lit(0.0)).alias("score"))


def detect(sequences: DataFrame, eps: Sequence[float], **options) -> DataFrame:
    """Markov scores flagged at every threshold in ``eps``."""
    return flag(markov_scores(sequences, **options), eps)
