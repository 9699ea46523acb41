"""Sliding score of each position of a client sequence; low scores are rare behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators import ordered as o
from loglattice.operators.lookup import lookup
from loglattice.operators.thresholds import flag
from loglattice.operators.transitions import train

# Fixed value: the score of a session whose sequence is too short to be scored.
UNSCORED = 1000000.0


def position_scores(
    sequences: DataFrame,
    table: DataFrame | None = None,
    *,
    l: int = 5,
    rows_per_block: int = o.ROWS_PER_BLOCK,
    max_length: int | None = None,
) -> DataFrame:
    """``(seq_id, pos, score)``: the sum of p*q over the transitions within ``l`` of a position.

    Sequences shorter than ``l`` give no rows. A position sees the end of such a sequence
    inside its own window, so no length has to be joined.
    """
    if table is None:
        table = train(sequences, rows_per_block=rows_per_block, max_length=max_length)
    rows = sequences.select("seq_id", "pos", "state")
    blocks, by = o.halo_blocks(rows, "pos", l, rows_per_block, max_length)
    along = Window.partitionBy(*by).orderBy("pos")
    moves = blocks.select(
        *by,
        "pos",
        "__own",
        F.col("state").alias("from_state"),
        F.lead("state").over(along).alias("to_state"),
    )
    moves = lookup(moves, table.select("from_state", "to_state", "pq"), ["from_state", "to_state"])
    near = along.rowsBetween(-(l - 1), l - 1)
    scored = moves.withColumns(
        {
            "score": F.coalesce(F.sum(F.coalesce("pq", F.lit(0.0))).over(near), F.lit(0.0)),
            "__reach": F.max("pos").over(near),
        }
    )
    return scored.where(F.col("__own") & (F.col("__reach") >= l - 1)).select("seq_id", "pos", "score")


def session_scores(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """``sessions (…, seq_id, pos)`` with the score of their position, or ``UNSCORED``."""
    return sessions.join(scores, ["seq_id", "pos"], "left").withColumn(
        "score", F.coalesce("score", F.lit(UNSCORED))
    )


def detect(
    sequences: DataFrame, sessions: DataFrame, eps: Sequence[float], *, l: int = 5, **options
) -> DataFrame:
    """Session scores flagged (``score < eps``) at every threshold in ``eps``."""
    scored = session_scores(sessions, position_scores(sequences, l=l, **options))
    return flag(scored, eps, low_is_anomalous=True)
