"""Metric documents: one nested row written and read as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.runtime import exists
from tallyforge.sources.tables import StageMissing


def write_document(df: DataFrame, path: str) -> None:
    """Write a one-row report as indented JSON, accents kept."""
    text = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, message: str) -> DataFrame:
    if not exists(spark, path):
        raise StageMissing(f"{message} ({path})")
    return spark.read.json(path, multiLine=True)
