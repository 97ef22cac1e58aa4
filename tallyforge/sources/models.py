"""Fitted model folders."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tallyforge.runtime import exists
from tallyforge.sources.tables import StageMissing


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, message: str = "model not prepared") -> PipelineModel:
    if not exists(SparkSession.active(), path):
        raise StageMissing(f"{message} ({path})")
    return PipelineModel.load(path)
