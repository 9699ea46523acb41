"""Scoring a live stream of labelled rows against a trained transition table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "client_ip string, ts timestamp, from_state double, to_state int"
_STATE = "last_ts timestamp, last_state int"


def _moves(idle_ms: int):
    """Adjacent states of one client in a batch, continuing from its last known state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "row_id"], kind="stable")
        last_ts, last_state = state.get if state.exists else (None, None)
        if last_ts is not None:
            # A row from before the last one came too late: a transition to it would run backwards.
            rows = rows[rows["ts"] >= last_ts]
        if len(rows):
            before = rows["label"].shift()
            if last_state is not None:
                before.iloc[0] = last_state
            last_ts, last_state = rows["ts"].iloc[-1], int(rows["label"].iloc[-1])
            state.update((last_ts, last_state))
            out = {"client_ip": key[0], "ts": rows["ts"], "from_state": before, "to_state": rows["label"]}
            yield pd.DataFrame(out).dropna(subset=["from_state"])
        seen = int(pd.Timestamp(last_ts).timestamp() * 1000)
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_ms)

    return run


def stream_transitions(rows: DataFrame, *, delay: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Stream of ``(row_id, client_ip, ts, label)`` to ``(client_ip, ts, from_state, to_state)``.

    The state of a client is its last time and label, so a transition across two batches counts. Rows later than ``delay``
    or older than the last row of their client are dropped, as are rows without a label. A client is forgotten
    when event time has passed it by ``idle_seconds``.
    """
    watched = rows.where("label IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    moves = watched.groupBy("client_ip").applyInPandasWithState(
        _moves(idle_seconds * 1000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return moves.select("client_ip", "ts", F.col("from_state").cast("int").alias("from_state"), "to_state")


def stream_surprise(rows: DataFrame, table: DataFrame, **options) -> DataFrame:
    """Adds ``surprise`` = -log2 P of every transition, +Infinity if the table lacks it.

    ``table`` is a stored transition table: at most one row per pair of clusters.
    """
    known = table.select("from_state", "to_state", "p")
    scored = stream_transitions(rows, **options).join(known, ["from_state", "to_state"], "left")
    surprise = F.when(F.col("p") > 0, -F.log2("p")).otherwise(F.lit(float("inf")))
    return scored.select("client_ip", "ts", "from_state", "to_state", surprise.alias("surprise"))
