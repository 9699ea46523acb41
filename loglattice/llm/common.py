"""Shared helpers: input columns, stored tables, range buckets and Arrow outputs."""

from __future__ import annotations

import math
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.session import shared_folder


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_FOLDERS: list[str] = []
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name under the shared folder that no other call gets."""
    _FOLDERS.append(f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clear_stored(spark: SparkSession) -> None:
    """Remove the tables this process has stored; results that still read them must be written before."""
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage: a lost executor costs a file read, not a new run. Every call writes to a
    folder of its own, so two runs never see each other's tables.
    Spark's listeners still know the step just ended, so its shuffle files go before the next one.
    """
    release(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished steps.

    Its cleaner acts when the driver collects garbage, which a driver with free memory does every half hour only; until
    then the files of all steps lie on the executors' disks together.
    """
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``store`` has returned and that nothing reads any more."""
    release(tables[0].sparkSession)
    for table in tables:
        path = _STORED.pop(table, None)
        if path is not None:
            _FOLDERS.remove(path)
            _delete(table.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> np.ndarray:
    """Lowest keys of consecutive ranges of about equal row counts, ascending.

    Only the key column is read and range-partitioned. There are at most four ranges per shuffle
    partition, so the list is bounded by a setting, not by the data.
    """
    keys = df.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL")
    rows = keys.count()
    wanted = max(1, min(math.ceil(rows / rows_per_bucket), 4 * partitions(df.sparkSession)))
    if wanted == 1:
        return np.zeros(0, dtype=np.int64)
    ranged = keys.repartitionByRange(wanted, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return np.unique(np.array([r["k"] for r in ranged.collect()], dtype=np.int64))[1:]


def bucket_of(bounds: np.ndarray) -> Callable[[Column], Column]:
    """Column function: the number of the range that a key lies in; null keys are in range 0."""

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        values = keys.fillna(low).astype("int64").to_numpy()
        return pd.Series(np.searchsorted(bounds, values, side="right").astype("int32"))

    return bucket


def arrow_map(df: DataFrame, schema: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], chunk: int = 2000) -> DataFrame:
    """mapInArrow over ``df`` for a generator of tuples; hands them on in batches of ``chunk``."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        for row in rows(batches):
            held.append(row)
            if len(held) >= chunk:
                yield batch()
                held = []
        if held:
            yield batch()

    return df.mapInArrow(run, fields)


def joined_spans(spans: Sequence[tuple[int, int, str, int]]) -> str:
    """Spans (start, order of the kind, kind, end), sorted, as kind:start:end joined by commas."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
