"""From a stored plane table to flagged client sequences, stage by stage.

Only the labelled rows are stored between the stages: clustering reads the input table more
than once, and every later stage reads the labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators import clustering, features, transitions
from loglattice.operators.dbscan import NOISE, dbscan
from loglattice.operators.detectors import directional, frequency, markov, session, similarity
from loglattice.operators.evaluate import balanced_f, detection_rates
from loglattice.operators.mixture import Mixture
from loglattice.operators.sequences import build_sequences
from loglattice.session import materialize, shared_folder
from loglattice.sources import tables
from loglattice.sources.logs import FILE_ORDER


@dataclass(frozen=True)
class DetectionPlan:
    """What to run: features, clusterer (``kmeans``, ``gmm`` or ``dbscan``), sequences, detector."""

    features: Sequence[str]
    numeric: Sequence[str] = ()
    clusterer: str = "kmeans"
    clusters: int = 5
    mode: str = "client"
    detector: str = "markov"
    eps: Sequence[float] = (1.0,)
    seed: int = 0
    hold_out: bool = True
    split_seed: int = 4
    feature_options: dict[str, Any] = field(default_factory=dict)
    cluster_options: dict[str, Any] = field(default_factory=dict)
    sequence_options: dict[str, Any] = field(default_factory=dict)
    detector_options: dict[str, Any] = field(default_factory=dict)


def noise_as_state(labels: DataFrame, label: str = "label") -> DataFrame:
    """Give noise rows a state of their own, numbered after the clusters."""
    after = labels.select(F.max(label) + 1).scalar()
    return labels.withColumn(label, F.when(F.col(label) == NOISE, after).otherwise(F.col(label)))


@dataclass(frozen=True)
class Trained:
    """What one log teaches for the next: the clusters, and the table or direction of the detector.

    ``model`` is a k-means model or a mixture; density clusters cannot label new rows.
    """

    model: KMeansModel | Mixture
    states: int
    table: DataFrame | None = None


def _vectors(plane: DataFrame, plan: DetectionPlan) -> tuple[DataFrame, list[str]]:
    """``(row_id, kept, features)`` of every row and the names of the feature columns."""
    order = plan.sequence_options.get("order") or default_order(plane)
    keep = [c for c in dict.fromkeys(("client_ip", "server_ip", "ts", *order)) if c in plane.columns and c != "row_id"]
    options = {"jittered": True, "seed": plan.seed, **plan.feature_options}
    table = features.input_table(plane, plan.features, plan.numeric, keep=keep, **options)
    columns = [c for c in table.columns if c not in ("row_id", "kept")]
    return features.assemble(table, columns).select("row_id", "kept", "features"), columns


def default_order(plane: DataFrame) -> tuple[str, ...]:
    """The order of the lines in their files where the table knows it, else of time and row id."""
    return FILE_ORDER if set(FILE_ORDER) <= set(plane.columns) else ("ts", "row_id")


def _fit(rows: DataFrame, plan: DetectionPlan):
    sweep: Callable = {"kmeans": clustering.kmeans_sweep, "gmm": clustering.gmm_sweep}[plan.clusterer]
    train = clustering.train_test(rows, seed=plan.split_seed)[0] if plan.hold_out else rows
    return sweep(train, [plan.clusters], seed=plan.seed, **plan.cluster_options)[plan.clusters]


def labelled_rows(plane: DataFrame, plan: DetectionPlan, trained: Trained | None = None) -> tuple[DataFrame, Any]:
    """``row_id``, the columns that sequences need and ``label`` of every row, stored; and the model.

    The model is fitted on nine rows in ten (``hold_out``) or all rows, or taken from ``trained``; then every row is
    labelled in the pass that reads it.
    """
    rows, _ = _vectors(plane, plan)
    folder, spark = shared_folder(plane.sparkSession), plane.sparkSession
    if plan.clusterer == "dbscan":
        rows = tables.store(rows, folder, tables.new_name("vectors"))
        points = rows.select("row_id", vector_to_array("features").alias("x"))
        labels = noise_as_state(materialize(dbscan(points, **plan.cluster_options)))
        labelled, model = rows.join(labels, "row_id"), None
    else:
        rows = rows if trained else tables.store(rows, folder, tables.new_name("vectors"))
        model = trained.model if trained else _fit(rows, plan)
        labelled = clustering.add_label(rows, model)
    labelled = labelled.select("row_id", "kept.*", "label")
    return tables.store(labelled, shared_folder(spark), tables.new_name("labelled")), model


def train(plane: DataFrame, plan: DetectionPlan) -> Trained:
    """Fit the clusters on ``plane`` and learn the detector's table from its sequences."""
    rows, model = labelled_rows(plane, plan)
    if model is None:
        raise ValueError("density clusters cannot label new rows")
    sequences = _sequences(rows, plane, plan)
    match plan.detector:
        case "markov" | "session":
            table = transitions.train(sequences)
        case "directional":
            table = materialize(directional.mean_direction(directional.direction_vectors(sequences, plan.clusters)))
        case _:
            table = None
    return Trained(model, plan.clusters, table)


def _sequences(rows: DataFrame, plane: DataFrame, plan: DetectionPlan) -> DataFrame:
    return build_sequences(rows, plan.mode, **{"order": default_order(plane), **plan.sequence_options})


def run(
    plane: DataFrame, plan: DetectionPlan, *, trained: Trained | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """Flags of the detector for every sequence (and threshold, where the detector has them).

    ``trained`` applies what another log taught. The ``session`` detector scores the positions ``sessions (seq_id, pos)``,
    by default all of them.
    """
    rows, _ = labelled_rows(plane, plan, trained)
    sequences = _sequences(rows, plane, plan)
    options = dict(plan.detector_options)
    if trained is not None and trained.table is not None:
        options["mean" if plan.detector == "directional" else "table"] = trained.table

    def states() -> int:
        known = trained.states if trained is not None else (rows.agg(F.max("label").alias("m")).first()["m"] or 0) + 1
        return max(known, plan.clusters if plan.clusterer != "dbscan" else known)

    match plan.detector:
        case "markov":
            return markov.detect(sequences, plan.eps, **options)
        case "session":
            picked = sequences.select("seq_id", "pos") if sessions is None else sessions
            return session.detect(sequences, picked, plan.eps, **options)
        case "lcs":
            return similarity.detect_lcs(sequences, plan.eps, **options)
        case "ngram":
            return similarity.detect_ngram(sequences, plan.eps, **options)
        case "directional":
            return directional.detect(sequences, states(), **options)
        case "frequency":
            return frequency.detect(sequences, states(), **{"clusters": plan.clusters, **options})
    raise ValueError(plan.detector)


def evaluate(flags: DataFrame, truth: DataFrame, *, on: Sequence[str] = ("seq_id",), rates: bool = False) -> DataFrame:
    """Quality of the flags per threshold against ``truth`` (keys and ``label``, 1 for an anomaly)."""
    known = truth.select(*on, F.col("label").alias("__truth"))
    joined = flags.join(known, list(on))
    by = ["eps"] if "eps" in flags.columns else []
    return (detection_rates if rates else balanced_f)(joined, truth="__truth", by=by)
