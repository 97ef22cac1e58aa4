"""Wide-to-long helpers shared by the report operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def long_rows(df: DataFrame, keys: list[str], rows: list[dict[str, str]]) -> DataFrame:
    """One output row per entry of ``rows`` for each input row, without a shuffle.

    An entry maps output names to SQL text.
    """
    entries = [
        "struct(" + ", ".join(f"{value} as `{name}`" for name, value in row.items()) + ")"
        for row in rows
    ]
    return df.selectExpr(*keys, f"inline(array({', '.join(entries)}))")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Put the columns of several one-row frames side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(
        *[F.first(name, ignorenulls=True).alias(name) for name in stacked.columns]
    )
