"""Preparation stages: clean, cluster, flag, model, load.

Every stage reads the stored output of the one before it and stores its own, so a stage
can be run again alone and a lost executor never costs more than one stage. Tables are
committed versions: a half-written one is never read, and a stage whose input has been
prepared anew since is refused until it is run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import quality, reconcile as rec
from tallyforge.operators.cleaning import clean
from tallyforge.operators.clustering import cluster_table
from tallyforge.operators.isolation import detect_anomalies
from tallyforge.operators.regressors import Fitter, candidate_models
from tallyforge.operators.serving import to_serving
from tallyforge.operators.validation import evaluate_models, permutation_importance, regression_metrics
from tallyforge.sources.documents import write_document
from tallyforge.sources.models import save_model
from tallyforge.sources.delimited import ROW_INDEX, read_delimited
from tallyforge.sources.manifests import latest, read_version, write_version
from tallyforge.sources.tables import load_serving_table


@dataclass(frozen=True)
class Workspace:
    """Folder of the prepared tables, models and metric documents."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _inputs(self, names: tuple[str, ...]) -> dict[str, str]:
        found = {name: latest(self.spark, self.path(name)) for name in names}
        return {name: manifest.fingerprint for name, manifest in found.items() if manifest}

    def write(self, name: str, rows: DataFrame, *made_from: str) -> None:
        """Commit a table; ``made_from`` names the tables that it was made from."""
        write_version(rows, self.path(name), self._inputs(made_from))

    def read(self, name: str, stage: str, *made_from: str) -> DataFrame:
        """A committed table; those named in ``made_from`` must not have changed since."""
        message = f"run the {stage} stage first"
        return read_version(self.spark, self.path(name), message, self._inputs(made_from))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path)


def prepare_clean(
    space: Workspace,
    raw: DataFrame,
    official: DataFrame | None = None,
    ordinal: str = ROW_INDEX,
    factors: dict[str, float] | None = None,
) -> None:
    space.write("clean", clean(raw, ordinal, factors))
    rows = space.read("clean", "cleaning")
    space.write("reconciliation", rec.reconcile(rows, official), "clean")
    reconciliation = space.read("reconciliation", "cleaning", "clean")
    write_document(quality.quality_report(rows, reconciliation), space.path("quality_report"))


def prepare_clusters(space: Workspace, sweep_restarts: int = 30, final_restarts: int = 40) -> None:
    rows = space.read("clean", "cleaning")
    clustered, metrics, model = cluster_table(
        rows, sweep_restarts=sweep_restarts, final_restarts=final_restarts
    )
    space.write("clustered", clustered, "clean")
    save_model(model, space.path("cluster_model"))
    write_document(metrics, space.path("cluster_metrics"))


def prepare_anomalies(space: Workspace, contamination: float = 0.08, trees: int = 400) -> None:
    rows = space.read("clustered", "clustering", "clean")
    flagged, metrics, _ = detect_anomalies(rows, contamination, trees)
    space.write("anomalies", flagged, "clustered")
    write_document(metrics, space.path("anomaly_metrics"))


def prepare_models(
    space: Workspace, models: dict[str, Fitter] | None = None, repeats: int = 20
) -> None:
    rows = space.read("anomalies", "anomaly", "clustered")
    comparison = evaluate_models(rows, models or candidate_models())
    importances = permutation_importance(rows, comparison.best_model, repeats=repeats)
    save_model(comparison.best_model, space.path("regression_model"))
    space.write("predictions", comparison.predictions, "anomalies")
    space.write("enriched", rows, "anomalies")
    write_document(
        regression_metrics(comparison, importances, rows.count()), space.path("regression_metrics")
    )


def prepare_all(
    space: Workspace,
    raw: DataFrame,
    official: DataFrame | None = None,
    ordinal: str = ROW_INDEX,
    factors: dict[str, float] | None = None,
    restarts: tuple[int, int] = (30, 40),
    isolation_trees: int = 400,
    models: dict[str, Fitter] | None = None,
    repeats: int = 20,
) -> None:
    prepare_clean(space, raw, official, ordinal, factors)
    prepare_clusters(space, *restarts)
    prepare_anomalies(space, trees=isolation_trees)
    prepare_models(space, models, repeats)


def load(space: Workspace, table: str, force: bool = False, path: str | None = None) -> int:
    rows = space.read("enriched", "model", "anomalies")
    return load_serving_table(to_serving(rows), table, force, path)
