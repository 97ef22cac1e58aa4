"""Flattening of nested metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Column prefix of each validation block.
VALIDATION_PREFIXES = {"kfold": "validation_kfold", "periode": "validation_par_periode"}
TRAINING_EXTRAS = ["mae_entrainement", "rmse_entrainement", "r2_entrainement"]


def flatten_results(results: DataFrame) -> DataFrame:
    """Model name, every metric of both validation blocks, training extras if present."""
    columns = [F.col("modele")]
    for prefix, block in VALIDATION_PREFIXES.items():
        if block in results.columns:
            columns += [
                F.col(f"{block}.{field}").alias(f"{prefix}_{field}")
                for field in results.schema[block].dataType.fieldNames()
            ]
    columns += [F.col(name) for name in TRAINING_EXTRAS if name in results.columns]
    return results.select(*columns)
