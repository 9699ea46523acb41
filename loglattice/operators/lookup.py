"""Joins of a large table with a lookup table that is unique on the key.

The lookup side is broadcast only after its size has been measured; above the limit the join is a plain
shuffle join. Rows of a frequent key are then split over many tasks by the skew join of adaptive
execution, which copies the lookup row of that key only (see ``build_session``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, nested ones summed up."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, VectorUDT):
        return _width(vector_to_array(value), T.ArrayType(T.DoubleType()))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType, VectorUDT)):
            inside = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType))
            return F.coalesce(inside, F.lit(0)).cast("long") + 16
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return _width(F.map_keys(value), keys) + _width(F.map_values(value), values)
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def measured_bytes(table: DataFrame) -> int:
    """Approximate size of ``table``; one pass over it, so pass a stored table."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16).cast("long"))
    return table.select(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join ``df`` with the stored lookup ``table`` (unique on ``on``)."""
    on = list(on)
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    return df.join(F.broadcast(table) if measured_bytes(table) <= limit else table, on, how)


def null_safe_lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where a null key matches a null key; adds the other columns of ``table``."""
    renamed = table.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in table.columns])
    match = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        match = part if match is None else match & part
    side = F.broadcast(renamed) if measured_bytes(table) <= BROADCAST_BYTES else renamed
    return df.join(side, match, "left").drop(*[f"__k_{c}" for c in on])
