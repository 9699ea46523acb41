"""Ordered scans (positions, running sums, neighbours) that survive a hot key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here a key with
more than ``rows_per_block`` rows is cut into blocks along its ordering columns, each block
is scanned by its own window, and small per-block summaries carry the running state
from one block to the next. Keys below the limit use one block and need no summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.operators.lookup import null_safe_lookup
from loglattice.session import materialize

ROWS_PER_BLOCK = 2_000_000
_BLOCK = "__block"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None


def position() -> Scan:
    """1-based row number inside the group."""
    return Scan("position")


def group_rows() -> Scan:
    """Number of rows of the whole group."""
    return Scan("group_rows")


def group_sum(value: Column) -> Scan:
    """Sum over the whole group."""
    return Scan("group_sum", value)


def running_sum(value: Column) -> Scan:
    """Sum of the rows up to and including this one."""
    return Scan("running_sum", value)


def running_max(value: Column) -> Scan:
    """Maximum of the rows up to and including this one."""
    return Scan("running_max", value)


def carried(value: Column) -> Scan:
    """Last non-null value up to and including this row."""
    return Scan("carried", value)


def previous(value: Column) -> Scan:
    """Value of the row before."""
    return Scan("previous", value)


def following(value: Column) -> Scan:
    """Value of the row after."""
    return Scan("following", value)


def _axis(df: DataFrame, name: str) -> Column:
    """The ordering column as a double (or as the string it is); only block borders use it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def _tail_number(x: Column, prefix: Column) -> Column:
    """The six bytes of a string after ``prefix`` characters as a number, in the order of the strings."""
    tail = F.hex(F.encode(F.substring(x, prefix + 1, F.lit(6)), "UTF-8"))
    return F.conv(F.rpad(F.substring(tail, 1, 12), 12, "0"), 16, 10).cast("double")


def _common_prefix(low: Column, high: Column) -> Column:
    """The number of characters two different strings start with alike."""
    shorter = F.least(F.length(low), F.length(high))
    return F.size(F.filter(F.sequence(F.lit(0), shorter), lambda i: F.left(low, i) == F.left(high, i))) - 1


def _oversized(df: DataFrame, by: list[str], order: list[str], rows_per_block: int) -> DataFrame:
    """The groups above ``rows_per_block`` with the ordering column to cut and the slice width.

    That column is the first one that varies inside the group. At most rows / rows_per_block
    groups pass.
    """
    found = {"__n": F.count(F.lit(1))}
    for i, name in enumerate(order):
        x = _axis(df, name)
        found |= {f"__lo{i}": F.min(x), f"__hi{i}": F.max(x), f"__c{i}": F.count(x)}
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()]).where(F.col("__n") > rows_per_block)
    pick = F.lit(None)
    for i in reversed(range(len(order))):
        some_null = (F.col(f"__c{i}") > 0) & (F.col(f"__c{i}") < F.col("__n"))
        varies = F.coalesce(F.col(f"__lo{i}") < F.col(f"__hi{i}"), F.lit(False)) | some_null
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        if isinstance(df.schema[order[i]].dataType, T.StringType):
            # All strings of the group share what its first and last start with; the bytes after that are cut like numbers.
            prefix = F.coalesce(_common_prefix(low, high), F.lit(0))
            first, last = _tail_number(low, prefix), _tail_number(high, prefix)
            # Strings that differ by zero bytes at the end only are told apart by the first one.
            text = F.when(first < last, F.lit(None).cast("string")).otherwise(low)
        else:
            first, last, prefix, text = low, high, F.lit(0), F.lit(None).cast("string")
        slices = F.ceil(F.col("__n") * F.lit(2.0 / rows_per_block)).cast("long")
        width = (last - first) / slices
        cut = (first, F.when(width > 0, width).otherwise(F.lit(1.0)), text, prefix.cast("int"), slices)
        names = ("low", "width", "text", "prefix", "slices")
        entry = F.struct(F.lit(i).alias("axis"), *[c.alias(n) for n, c in zip(names, cut)])
        pick = F.when(varies, entry).otherwise(pick)
    return stats.select(*by, pick.alias("__cut")).where(F.col("__cut").isNotNull())


def _deeper(df: DataFrame, order: list[str], radix: int, kind: str) -> Column:
    """The block number of a row with one more digit: its slice where the block is to be cut."""
    digit = F.lit(None).cast("long")
    cut = F.col("__cut")
    for i, name in enumerate(order):
        x = _axis(df, name)
        if isinstance(df.schema[name].dataType, T.StringType):
            by_bytes = F.floor((_tail_number(x, cut["prefix"]) - cut["low"]) / cut["width"]).cast("long")
            slice_ = F.when(cut["text"].isNull(), by_bytes).otherwise((x > cut["text"]).cast("long"))
        else:
            slice_ = F.floor((x - cut["low"]) / cut["width"]).cast("long")
        digit = F.when(cut["axis"] == i, F.coalesce(slice_, F.lit(-1)) + 1).otherwise(digit)
    block = F.col(_BLOCK).cast(kind) * F.lit(radix).cast(kind)
    return (block + F.when(cut.isNull(), 0).otherwise(digit)).cast(kind)


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` inside each group."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        rows_per_block: int = ROWS_PER_BLOCK,
        sized_by: DataFrame | None = None,
    ) -> None:
        """``sized_by``: a cheaper frame with the keys and leading ordering columns to count on.

        Groups above the limit are cut along their ordering until no block exceeds it; the
        digits of a block number are its slices, so block numbers sort as the rows do.
        """
        self.keys, self.order = list(keys), list(order)
        source = df if sized_by is None else sized_by
        axes = [c for i, c in enumerate(self.order) if set(self.order[: i + 1]) <= set(source.columns)]
        # The first question reads the keys alone and is usually the last.
        sizes = source.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__many"))
        large = materialize(sizes.where(F.col("__many") > rows_per_block))
        self.blocked = not large.isEmpty()
        self._df = df
        if not self.blocked:
            return
        root = F.lit(0).cast("long")
        df = df.withColumns({_BLOCK: root, "__hot": F.lit(False)})
        source = null_safe_lookup(source, large, self.keys).where(F.col("__many").isNotNull())
        source = source.withColumn(_BLOCK, root)
        by = self.keys
        hot = materialize(_oversized(source, by, axes, rows_per_block))
        numbers = 1
        while not hot.isEmpty():
            radix = hot.agg(F.max("__cut.slices").alias("s")).first()["s"] + 3
            numbers *= radix
            kind = "long" if numbers < 1 << 62 else "decimal(38,0)"
            df = null_safe_lookup(df, hot, by)
            df = df.withColumns({_BLOCK: _deeper(df, axes, radix, kind), "__hot": F.col("__hot") | F.col("__cut").isNotNull()})
            df = df.drop("__cut")
            # Only the blocks just cut can still be too large.
            source = null_safe_lookup(source, hot, by).where(F.col("__cut").isNotNull())
            source = source.withColumn(_BLOCK, _deeper(source, axes, radix, kind)).drop("__cut")
            by = [*self.keys, _BLOCK]
            hot = materialize(_oversized(source, by, axes, rows_per_block))
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_BLOCK, "__hot") if self.blocked else self._df

    def scan(self, **columns: Scan) -> OrderedGroups:
        """Add one column per scan; scans of one call cannot read each other."""
        by = [*self.keys, _BLOCK] if self.blocked else self.keys
        ordered = Window.partitionBy(*by).orderBy(*self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        local = {name: _local(s, ordered, upto, whole) for name, s in columns.items()}
        if not self.blocked:
            out = self._df.withColumns({n: _unwrap(columns[n], c) for n, c in local.items()})
            return self._with(out)

        offsets = materialize(self._offsets(columns))
        out = self._df.withColumns({f"__l_{n}": c for n, c in local.items()})
        out = null_safe_lookup(out, offsets, by)
        merged = {
            n: _merge(columns[n].kind, F.col(f"__l_{n}"), F.col(f"__o_{n}")) for n in columns
        }
        drop = [f"__{side}_{n}" for n in columns for side in "lo"]
        return self._with(out.withColumns(merged).drop(*drop))

    def derive(self, **columns: Column) -> OrderedGroups:
        """Add row-wise columns, so that a later scan can read an earlier one."""
        return self._with(self._df.withColumns(columns))

    def where(self, condition: Column) -> OrderedGroups:
        return self._with(self._df.where(condition))

    def _with(self, df: DataFrame) -> OrderedGroups:
        twin = object.__new__(OrderedGroups)
        twin.keys, twin.order, twin.blocked, twin._df = self.keys, self.order, self.blocked, df
        return twin

    def _offsets(self, columns: dict[str, Scan]) -> DataFrame:
        """State entering each block of a hot key: one row per block."""
        at = F.struct(*self.order)
        per_block = (
            self._df.where("__hot")
            .groupBy(*self.keys, _BLOCK)
            .agg(*[_summary(s, at).alias(n) for n, s in columns.items()])
        )
        along = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        return per_block.select(
            *self.keys,
            _BLOCK,
            *[_entering(s.kind, n, along, before, whole).alias(f"__o_{n}") for n, s in columns.items()],
        )


def _local(s: Scan, ordered, upto, whole) -> Column:
    match s.kind:
        case "position":
            return F.row_number().over(ordered).cast("long")
        case "group_rows":
            return F.count(F.lit(1)).over(whole)
        case "group_sum":
            return F.sum(s.value).over(whole)
        case "running_sum":
            return F.sum(s.value).over(upto)
        case "running_max":
            return F.max(s.value).over(upto)
        case "carried":
            return F.last(s.value, ignorenulls=True).over(upto)
        case "previous":
            return F.lag(F.struct(s.value.alias("v"))).over(ordered)
        case "following":
            return F.lead(F.struct(s.value.alias("v"))).over(ordered)
    raise ValueError(s.kind)


def _unwrap(s: Scan, column: Column) -> Column:
    return column.getField("v") if s.kind in ("previous", "following") else column


def _summary(s: Scan, at: Column) -> Column:
    match s.kind:
        case "position" | "group_rows":
            return F.count(F.lit(1))
        case "group_sum" | "running_sum":
            return F.sum(s.value)
        case "running_max":
            return F.max(s.value)
        case "carried":
            return F.max_by(s.value, F.when(s.value.isNotNull(), at))
        case "previous":
            return F.max_by(F.struct(s.value.alias("v")), at)
        case "following":
            return F.min_by(F.struct(s.value.alias("v")), at)
    raise ValueError(s.kind)


def _entering(kind: str, name: str, along, before, whole) -> Column:
    match kind:
        case "position" | "running_sum":
            return F.sum(name).over(before)
        case "group_rows" | "group_sum":
            return F.sum(name).over(whole)
        case "running_max":
            return F.max(name).over(before)
        case "carried":
            return F.last(name, ignorenulls=True).over(before)
        case "previous":
            return F.lag(name).over(along)
        case "following":
            return F.lead(name).over(along)
    raise ValueError(kind)


def _merge(kind: str, local: Column, entering: Column) -> Column:
    match kind:
        case "position" | "running_sum":
            return F.when(entering.isNull(), local).when(local.isNull(), entering).otherwise(entering + local)
        case "running_max":
            return F.greatest(entering, local)
        case "group_rows" | "group_sum":
            return F.coalesce(entering, local)
        case "carried":
            return F.coalesce(local, entering)
        case "previous" | "following":
            return F.coalesce(local, entering).getField("v")
    raise ValueError(kind)


def halo_blocks(
    df: DataFrame, pos: str, reach: int, rows_per_block: int, max_length: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Cut positioned sequences into blocks of ``rows_per_block`` with ``reach`` border copies.

    Adds ``__block`` and ``__own``: a row near a border is also sent to the neighbouring
    block (``__own`` false there), so a window over (sequence, ``__block``) sees every
    neighbour up to ``reach`` rows away while no task holds more than one block. Returns the
    columns to partition by, too: with ``max_length`` (no sequence is longer) within the block
    size that is the sequence alone, and later aggregations by sequence need no shuffle.
    """
    if max_length is not None and max_length <= rows_per_block:
        return df.withColumn("__own", F.lit(True)), ["seq_id"]
    size = max(rows_per_block, reach + 1)
    block = F.floor(F.col(pos) / F.lit(size))
    inside = F.pmod(F.col(pos), F.lit(size))
    own = block.cast("long")
    copies = (
        F.when((inside < reach) & (block > 0), F.array(own, own - 1))
        .when(inside >= size - reach, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    if size <= 2 * reach:
        copies = F.array(own, own - 1, own + 1)
    cut = (
        df.withColumn("__home", own)
        .withColumn(_BLOCK, F.explode(copies))
        .withColumn("__own", F.col("__home") == F.col(_BLOCK))
        .drop("__home")
    )
    return cut, ["seq_id", _BLOCK]
