"""Sequences of states (cluster labels) per client.

Long form ``(seq_id STRING, pos LONG, state)``, positions from 0. Every mode is a scan over
one ordering of the rows, so a client holding a large share of the log is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators import ordered as o


def _emit(df: DataFrame, name: Column, pos: Column, state: str, keep: Sequence[str]) -> DataFrame:
    return df.select(
        name.alias("seq_id"), pos.cast("long").alias("pos"), F.col(state).alias("state"), *keep
    )


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _named(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """Copies of the naming columns as text, so that a missing name and ``-`` are one group."""
    names = [f"__name{i}" for i in range(len(columns))]
    return df.withColumns({n: _text(c) for n, c in zip(names, columns)}), names


def by_client(
    df: DataFrame,
    *,
    client: str = "client_ip",
    order: Sequence[str] = ("ts", "row_id"),
    state: str = "label",
    keep: Sequence[str] = (),
    rows_per_block: int = o.ROWS_PER_BLOCK,
) -> DataFrame:
    """One sequence per client, rows in log order."""
    named, by = _named(df, client)
    rows = o.OrderedGroups(named, by, order, rows_per_block=rows_per_block)
    rows = rows.scan(__rn=o.position()).df
    return _emit(rows, _text(client), F.col("__rn") - 1, state, keep)


def by_time_gap(
    df: DataFrame,
    *,
    gap: float | None = 3600,
    client: str = "client_ip",
    ts: str = "ts",
    order: Sequence[str] = ("ts", "row_id"),
    state: str = "label",
    keep: Sequence[str] = (),
    rows_per_block: int = o.ROWS_PER_BLOCK,
) -> DataFrame:
    """A new sequence of a client starts where at least ``gap`` seconds passed.

    Named ``client_k`` with k from 0; ``gap=None`` never splits and keeps the client name.
    """
    if gap is None:
        return by_client(
            df, client=client, order=order, state=state, keep=keep, rows_per_block=rows_per_block
        )
    pause = F.unix_micros(ts) - F.unix_micros("__before")
    starts = F.when(F.col("__before").isNotNull() & (pause >= int(gap * 1_000_000)), 1).otherwise(0)
    named, by = _named(df, client)
    rows = (
        o.OrderedGroups(named, by, order, rows_per_block=rows_per_block)
        .scan(__before=o.previous(F.col(ts)), __rn=o.position())
        .derive(__cut=starts)
        .scan(
            __k=o.running_sum(F.col("__cut")),
            __first=o.running_max(F.when((F.col("__cut") == 1) | (F.col("__rn") == 1), F.col("__rn"))),
        )
        .df
    )
    name = F.concat_ws("_", _text(client), F.col("__k").cast("string"))
    return _emit(rows, name, F.col("__rn") - F.col("__first"), state, keep)


def by_chunk(
    df: DataFrame,
    *,
    many: int = 10,
    client: str = "client_ip",
    order: Sequence[str] = ("ts", "row_id"),
    state: str = "label",
    keep: Sequence[str] = (),
    rows_per_block: int = o.ROWS_PER_BLOCK,
) -> DataFrame:
    """Chunks of ``many`` rows per client; a remainder of a single row makes no sequence."""
    named, by = _named(df, client)
    rows = o.OrderedGroups(named, by, order, rows_per_block=rows_per_block)
    rows = rows.scan(__rn=o.position(), __n=o.group_rows()).df
    at = F.col("__rn") - 1
    chunk = F.floor(at / many)
    left = F.col("__n") - chunk * many
    rows = rows.where((left >= many) | (left >= 2))
    name = F.concat_ws("_", _text(client), chunk.cast("string"))
    return _emit(rows, name, F.pmod(at, F.lit(many)), state, keep)


def by_pair(
    df: DataFrame,
    *,
    client: str = "client_ip",
    server: str = "server_ip",
    order: Sequence[str] = ("ts", "row_id"),
    state: str = "label",
    keep: Sequence[str] = (),
    rows_per_block: int = o.ROWS_PER_BLOCK,
) -> DataFrame:
    """One sequence per (client, server), named ``client_server``."""
    named, by = _named(df, client, server)
    rows = o.OrderedGroups(named, by, order, rows_per_block=rows_per_block)
    rows = rows.scan(__rn=o.position()).df
    return _emit(rows, F.concat_ws("_", _text(client), _text(server)), F.col("__rn") - 1, state, keep)


def by_server_run(
    df: DataFrame,
    *,
    client: str = "client_ip",
    server: str = "server_ip",
    order: Sequence[str] = ("ts", "row_id"),
    state: str = "label",
    keep: Sequence[str] = (),
    drop_last_run: bool = False,
    rows_per_block: int = o.ROWS_PER_BLOCK,
) -> DataFrame:
    """Runs of one server inside a client, named ``client_server_NNN``.

    NNN counts the earlier runs of the same pair. ``drop_last_run`` leaves out the final run
    of each client.
    """
    named, by = _named(df, client, server)
    opened = (
        o.OrderedGroups(named, by[:1], order, rows_per_block=rows_per_block)
        .scan(__before=o.previous(F.col(by[1])), __rn=o.position())
        .derive(__open=F.when((F.col("__rn") > 1) & (F.col("__before") == F.col(by[1])), 0).otherwise(1))
    )
    scans = {"__first": o.running_max(F.when(F.col("__open") == 1, F.col("__rn")))}
    if drop_last_run:
        scans |= {
            "__run": o.running_sum(F.col("__open")),
            "__runs": o.group_sum(F.col("__open")),
        }
    rows = opened.scan(**scans).df
    # All rows of a run share the count of runs opened so far by their own (client, server).
    rows = (
        o.OrderedGroups(rows, by, order, rows_per_block=rows_per_block, sized_by=named)
        .scan(__seen=o.running_sum(F.col("__open")))
        .df
    )
    if drop_last_run:
        rows = rows.where(F.col("__run") < F.col("__runs"))
    nth = F.col("__seen") - 1
    number = F.when(nth < 1000, F.lpad(nth.cast("string"), 3, "0")).otherwise(nth.cast("string"))
    name = F.concat_ws("_", _text(client), _text(server), number)
    return _emit(rows, name, F.col("__rn") - F.col("__first"), state, keep)


MODES = {
    "client": by_client,
    "gap": by_time_gap,
    "chunk": by_chunk,
    "pair": by_pair,
    "run": by_server_run,
}


def build_sequences(df: DataFrame, mode: str = "client", **options) -> DataFrame:
    """Sequences by one of ``client``, ``gap``, ``chunk``, ``pair``, ``run``."""
    return MODES[mode](df, **options)


def attach_labels(rows: DataFrame, labels: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows with the label stored for them elsewhere."""
    return rows.join(labels, on, "inner")


def adjacent(
    sequences: DataFrame, *, rows_per_block: int = o.ROWS_PER_BLOCK, max_length: int | None = None
) -> DataFrame:
    """Each position with its own and the next state: ``(seq_id, pos, from_state, to_state)``.

    The last position of a sequence has a null ``to_state``. ``max_length`` states that no
    sequence is longer (chunks), which saves shuffles.
    """
    rows = sequences.select("seq_id", "pos", "state")
    blocks, by = o.halo_blocks(rows, "pos", 1, rows_per_block, max_length)
    along = Window.partitionBy(*by).orderBy("pos")
    return (
        blocks.withColumn("to_state", F.lead("state").over(along))
        .where("__own")
        .select("seq_id", "pos", F.col("state").alias("from_state"), "to_state")
    )


def as_arrays(sequences: DataFrame) -> DataFrame:
    """``(seq_id, states ARRAY)``, for whole-sequence comparison of bounded sequences."""
    return sequences.groupBy("seq_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "state"))), lambda s: s.getField("state")
        ).alias("states")
    )
