"""Contract checks raised before any job runs, and the scoring-input split."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.schema import CATEGORY, PERIOD, SCORING_COUNTS, SCORING_DEFAULT_PERIOD


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_limit(limit: int, highest: int) -> int:
    if not 1 <= limit <= highest:
        raise ValueError(f"limit must lie between 1 and {highest}, got {limit}")
    return limit


def check_choice(value: str, allowed: Iterable[str]) -> str:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"unknown choice {value!r}, expected one of {allowed}")
    return value


def with_scoring_defaults(df: DataFrame) -> DataFrame:
    """Fill the optional inputs: the default period and zero counts."""

    def or_default(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    require_columns(df, ["categorie"])
    kept = [c for c in df.columns if c not in {"annee", "categorie", *SCORING_COUNTS}]
    return df.select(
        *kept,
        or_default("annee", F.lit(SCORING_DEFAULT_PERIOD)).alias("annee"),
        "categorie",
        *[or_default(n, F.lit(0)).cast("long").alias(n) for n in SCORING_COUNTS],
    )


def split_scoring_input(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for scoring, under the model's feature names, and the rejected rows."""
    filled = with_scoring_defaults(df)
    valid = F.col("categorie").isNotNull()
    for name in SCORING_COUNTS:
        valid = valid & (F.col(name) >= 0)
    names = {"annee": PERIOD, "categorie": CATEGORY, **SCORING_COUNTS}
    return filled.where(valid).withColumnsRenamed(names), filled.where(~valid)
