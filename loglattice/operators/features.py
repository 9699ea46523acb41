"""From the plane table to a numeric input table: one column expression per feature."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions import fields, url
from loglattice.operators.lookup import lookup
from loglattice.operators.scaling import jitter, min_max
from loglattice.session import materialize

def one_client(plane: DataFrame, client: str | int, column: str = "client_ip") -> DataFrame:
    """The rows of one client; the filter reaches the scan."""
    return plane.where(F.col(column) == client)


def blacklist_flag(
    df: DataFrame, blacklist: DataFrame, column: str, name: str | None = None, **options
) -> DataFrame:
    """1.0 where ``column`` is a key of the blacklist, else 0.0; the label plays no part."""
    keys = materialize(blacklist.select(F.col("key").alias(column)).where(F.col(column).isNotNull()).distinct())
    marked = lookup(df, keys.withColumn("__listed", F.lit(True)), [column], **options)
    flag = F.coalesce(F.col("__listed"), F.lit(False)).cast("double")
    return marked.withColumn("__flag", flag).drop("__listed").withColumnRenamed("__flag", name or f"{column}_listed")


def listed(df: DataFrame, blacklist: DataFrame, column: str, **options) -> DataFrame:
    """Rows whose ``column`` is a key of the blacklist."""
    keys = materialize(blacklist.select(F.col("key").alias(column)).distinct())
    return lookup(df, keys, [column], "left_semi", **options)


def unlisted(df: DataFrame, blacklist: DataFrame, column: str, **options) -> DataFrame:
    """Rows whose ``column`` is no key of the blacklist."""
    keys = materialize(blacklist.select(F.col("key").alias(column)).distinct())
    return lookup(df, keys, [column], "left_anti", **options)


def file_type_flags(kind: Column) -> dict[str, Column]:
    """One 0/1 column per known type, ``file_type_other``, and ``file_type_`` (always 0)."""
    out = {f"file_type_{t}": (kind == t).cast("double") for t in url.FILE_TYPES}
    return out | {"file_type_other": (kind == "other").cast("double"), "file_type_": F.lit(0.0)}


def _shared_parts(plane: DataFrame, features: Sequence[str], component: str) -> DataFrame:
    """Intermediate columns several features read, so that each regex runs once a row."""
    address = F.col("url_from_client")
    parts: dict[str, Column] = {}
    if {"file_type", "URL_path_length"} & set(features):
        parts["__path"] = url.path(address)
    if {"URL_query_length", "URL_query_key_number"} & set(features):
        parts["__part"] = url.component(address, component)
    if "server_IP_binary" in features:
        parts["__ip"] = fields.ip_number(F.col("server_ip"))
    if "status_to_client" in features:
        parts["__class"] = F.floor(F.col("status_to_client").try_cast("int") / 100)
    plane = plane.withColumns(parts) if parts else plane
    return plane.withColumn("__kind", url.file_type_of_path(F.col("__path"))) if "file_type" in features else plane


def _feature_columns(feature: str, compat: bool) -> dict[str, Column]:
    """Columns of one feature; a name without a rule of its own is passed through."""
    match feature:
        case "status_to_client":
            flags = fields.status_class_flags(F.col("__class"), zero_is_five=compat)
            if compat:
                flags.pop("status_other")
            return flags
        case "size_of_reply":
            return {feature: F.col(feature).try_cast("double")}
        case "file_type":
            return file_type_flags(F.col("__kind"))
        case "URL_length":
            return {feature: url.url_length(F.col("url_from_client"))}
        case "URL_path_length":
            return {feature: F.length("__path").cast("double")}
        case "URL_query_length":
            return {feature: F.length("__part").cast("double")}
        case "URL_query_key_number":
            return {feature: url.equal_signs(F.col("__part"))}
        case "URL_have_IP":
            return {feature: url.has_ipv4(F.col("url_from_client"))}
        case "server_IP_binary":
            bits = fields.ip_bits(F.col("server_ip"), F.col("__ip"))
            if compat:
                bits.pop("ip_valid")
            return bits
        case _:
            return {feature: F.col(feature)}


def dummies(df: DataFrame, columns: Sequence[str], values: dict[str, Sequence[str]]) -> DataFrame:
    """Replace string columns by 0/1 columns ``column_value`` for the given values, after the other columns.

    For values that are only in the data use ``sparse_dummies`` or ``dummies_long``.
    """
    kept = [c for c in df.columns if c not in columns]
    flags = [
        F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for c in columns
        for v in values[c]
    ]
    return df.select(*kept, *flags)


def dummy_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, slot)``: the observed values of each column, numbered from 0 in their order; stored.

    Values are range-partitioned and counted per partition, so neither a task nor the driver holds
    them all: the driver sees one number per partition and column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    seen = df.select(pairs).select("p.*").where("value IS NOT NULL").distinct()
    ranged = seen.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = ranged.groupBy("feature", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("feature", "part").collect()
    starts, before = [], {}
    for r in counts:
        starts.append((r["feature"], r["part"], r["first"] - before.get(r["feature"], 0)))
        before[r["feature"]] = before.get(r["feature"], 0) + r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "feature string, part long, low long")
    numbered = ranged.withColumn("part", part).join(F.broadcast(offsets), ["feature", "part"])
    return materialize(numbered.select("feature", "value", (F.col("at") - F.col("low")).cast("int").alias("slot")))


def sparse_dummies(df: DataFrame, columns: Sequence[str], values: DataFrame | None = None) -> DataFrame:
    """Replace string columns by sparse 0/1 vectors over their observed values; a null is all zeros.

    ``values`` is the result of ``dummy_values`` (made here if missing), whose ``slot`` is the place in
    the vector. Values that are not in it are all zeros, as null is.
    """
    values = dummy_values(df, columns) if values is None else values
    seen = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {c: max(seen.get(c, 0), 1) for c in columns}
    order = df.columns
    for c in columns:
        own = values.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("slot").alias(f"__slot_{c}"))
        df = lookup(df.withColumn(c, F.col(c).cast("string")), own, [c])
    # The schema tells the size only: a name for each slot, as Spark's encoder writes, would fill the driver.
    hot = {c: _unit_vector(sizes[c])(f"__slot_{c}").alias(c, metadata={"ml_attr": {"num_attrs": sizes[c]}}) for c in columns}
    return df.select(*[hot.get(c, F.col(c)) for c in order])


def _unit_vector(size: int) -> Callable[..., Column]:
    """A slot as a sparse vector with a one there, all zeros for a null."""
    return F.udf(lambda slot: Vectors.sparse(size, [], []) if slot is None else Vectors.sparse(size, [slot], [1.0]), VectorUDT())


def dummies_long(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The non-zero dummies as ``(row_id, feature, x)``, for any number of values."""
    names = F.array(*[F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in columns])
    out = df.select(row_id, F.explode(names).alias("feature"), F.lit(1.0).alias("x"))
    return out.where(F.col("feature").isNotNull())


def input_table(
    plane: DataFrame,
    features: Sequence[str],
    numeric: Sequence[str] = (),
    *,
    ip_blacklist: DataFrame | None = None,
    host_blacklist: DataFrame | None = None,
    values: dict[str, Sequence[str]] | None = None,
    jittered: bool = False,
    seed: int = 0,
    component: str = "query",
    compat: bool = False,
    row_id: str = "row_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The numeric table of the requested features: ``row_id`` and DOUBLE columns, none of them null.

    ``numeric`` names the features scaled to [0, 1]. A value that is missing or no number becomes 0 and sets
    the 0/1 column ``<name>_missing`` (for ``numeric`` features). String features become 0/1 columns of the values
    given in ``values``, or else one sparse vector column over all observed values. With ``jittered`` every
    plain column that is not scaled gets noise in [-0.5, 0.5) fixed by the row id. ``keep`` names columns of
    ``plane`` to carry along, in one struct column ``kept``.
    """
    plane = _shared_parts(plane, features, component)
    flags = {"server_ip": ip_blacklist, "server_peer_name": host_blacklist}
    for column, blacklist in flags.items():
        if column in features and blacklist is not None:
            plane = blacklist_flag(plane, blacklist, column, f"__{column}")
    columns: dict[str, Column] = {}
    for feature in features:
        if feature in flags:
            if flags[feature] is None:
                raise ValueError(f"feature {feature} needs its blacklist")
            columns[feature] = F.col(f"__{feature}")
        else:
            columns |= _feature_columns(feature, compat)
    for name in numeric:
        columns[name] = columns[name].try_cast("double")
    fixed = [row_id, "kept"] if keep else [row_id]
    carried = [F.struct(*keep).alias("kept")] if keep else []
    table = plane.select(row_id, *carried, *[c.alias(n) for n, c in columns.items()])
    text = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in fixed]
    plain = [c for c in table.columns if c not in (*fixed, *text)]
    table = table.select(*[F.col(c).cast("double").alias(c) if c in plain else F.col(c) for c in table.columns])
    lacking = {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}
    table = table.withColumns(lacking) if numeric else table
    table = min_max(table, list(numeric)) if numeric else table
    table = table.fillna(0.0, plain)
    given = [c for c in text if c in (values or {})]
    if given:
        table = dummies(table, given, values)
    vectors = [c for c in text if c not in given]
    if vectors:
        table = sparse_dummies(table, vectors)
    if jittered:
        loose = [c for c in table.columns if c not in (*numeric, *lacking, *vectors, *fixed)]
        table = jitter(table, loose, row_id=row_id, seed=seed)
    return table


def assemble(table: DataFrame, columns: Sequence[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """Add the ``features`` vector of ``columns`` (default: all but the row id)."""
    columns = list(columns or [c for c in table.columns if c not in (row_id, "kept")])
    return VectorAssembler(inputCols=columns, outputCol="features").transform(table)
