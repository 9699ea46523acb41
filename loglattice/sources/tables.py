"""Named tables and models under one folder of the shared file system."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession

from loglattice.operators.mixture import Mixture

_MIXTURE = "component int, weight double, mean array<double>, cov array<array<double>>"


def new_name(name: str) -> str:
    """A name no other run uses, for tables that only this run reads."""
    return f"{name}-{uuid.uuid4().hex}"


def store(
    df: DataFrame, folder: str, name: str, *, partition_by: Sequence[str] = (), overwrite: bool = False
) -> DataFrame:
    """Write ``df`` as ``folder/name`` and return the stored table.

    A name in use is an error, as lazy tables may still read its files; ``overwrite`` replaces it.
    """
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite" if overwrite else "error").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def store_model(spark: SparkSession, model: MLWritable | Mixture, folder: str, name: str, *, overwrite: bool = False) -> str:
    """Save a fitted model; a mixture becomes a table with one row per component."""
    path = f"{folder.rstrip('/')}/{name}"
    if isinstance(model, Mixture):
        rows = [(i, float(w), m.tolist(), c.tolist()) for i, (w, m, c) in enumerate(zip(model.weights, model.means, model.covs))]
        parts = spark.createDataFrame(rows, _MIXTURE).coalesce(1)
        parts.write.mode("overwrite" if overwrite else "error").parquet(path)
    else:
        writer = model.write()
        (writer.overwrite() if overwrite else writer).save(path)
    return path


def load_model(spark: SparkSession, kind: type[MLReadable] | type[Mixture], folder: str, name: str):
    """``kind`` is the model class, e.g. ``KMeansModel`` or ``Mixture``."""
    path = f"{folder.rstrip('/')}/{name}"
    if kind is not Mixture:
        return kind.load(path)
    rows = spark.read.schema(_MIXTURE).parquet(path).orderBy("component").collect()
    return Mixture(*(np.array([r[c] for r in rows]) for c in ("weight", "mean", "cov")))
