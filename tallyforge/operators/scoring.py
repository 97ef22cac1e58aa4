"""Batch scoring with a fitted regression model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.numbers import round_sql
from tallyforge.operators.contracts import split_scoring_input
from tallyforge.operators.regressors import PREDICTION
from tallyforge.schema import CATEGORY, PERIOD, SCORING_COUNTS


def score(df: DataFrame, model: PipelineModel, model_name: str) -> tuple[DataFrame, DataFrame]:
    """Estimates for the valid rows, clipped at 0 and rounded, and the rejected rows."""
    valid, rejected = split_scoring_input(df)
    kept = [c for c in df.columns if c not in {"annee", "categorie", *SCORING_COUNTS}]
    estimate = round_sql(f"greatest({PREDICTION}, 0D)", 2)
    scored = model.transform(valid).select(
        *kept,
        F.col(PERIOD).alias("annee"),
        F.col(CATEGORY).alias("categorie"),
        F.expr(f"{estimate} as resultats_def_estimes"),
        F.lit(model_name).alias("modele"),
    )
    return scored, rejected
