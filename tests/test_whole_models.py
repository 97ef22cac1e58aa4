"""Registered queries fit the four models with all their trees and rounds."""

import pytest

from tallyforge.operators import regressors
from tallyforge.plans import registry, stages


@pytest.fixture
def asked(monkeypatch):
    found = {}
    monkeypatch.setattr(regressors, "fit_forest_lanes", lambda df, held_out, trees: found.update(trees=trees))
    monkeypatch.setattr(regressors, "fit_boosting_lanes", lambda df, held_out, rounds: found.update(rounds=rounds) or ([], []))
    return found


def fit(models):
    assert list(models) == [regressors.MEDIAN, regressors.RIDGE, regressors.FOREST, regressors.BOOSTING]
    for name in (regressors.FOREST, regressors.BOOSTING):
        models[name].lanes(None, [None])


def test_comparison_is_whole(asked, monkeypatch):
    """m13_model_comparison, m13_comparison_checks, m18_regression_metrics and m18_document_checks start here."""
    monkeypatch.setattr(registry, "stored_model_rows", lambda spark, sf_dir: "rows")
    monkeypatch.setattr(registry.validation, "evaluate_models", lambda df, models: fit(models))
    registry._comparison(None, "")
    assert asked == {"trees": 350, "rounds": 220}


def test_prepared_stages_are_whole(asked, monkeypatch):
    """x1_prepare_stages, x1_stage_checks and x2_prepare_and_load start here."""
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: name)
    monkeypatch.setattr(registry.cells, "coarse_and_official", lambda spark, sf_dir: (None, None))
    repeated, settings = [], []
    monkeypatch.setattr(stages, "prepare_clean", lambda *given: None)
    monkeypatch.setattr(stages, "prepare_clusters", lambda space, *restarts: settings.append(restarts))
    monkeypatch.setattr(stages, "prepare_anomalies", lambda space, trees: settings.append(trees))
    monkeypatch.setattr(stages, "prepare_models", lambda space, models, repeats: fit(models or stages.candidate_models()) or repeated.append(repeats))
    registry._prepared(None, "")
    assert asked == {"trees": 350, "rounds": 220} and repeated == [20] and settings == [(30, 40), 400]
