"""Robust scores, strict threshold rules, reasons and severity levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import number_sql, round_half_even
from tallyforge.operators.quantiles import exact_quantiles

SCORE = "Score_anomalie"
ML_FLAG = "Anomalie_ML"
RULE_FLAG = "Anomalie_regle"
FLAG = "Est_anomalie"
REASONS = "Raisons_anomalie"
REASON_LIST = "Raisons"
LEVEL = "Niveau_anomalie"


def robust_z(df: DataFrame, column: str, output: str = "robust_z") -> DataFrame:
    """Distance to the median in scaled median deviations.

    Falls back to the plain z score when the median deviation is 0, then to 0.
    """
    value = F.col(column).cast("double")
    middle = exact_quantiles(df, [column], [0.5])[column][0]
    if middle is None:
        return df.withColumn(output, F.lit(None).cast("double"))
    deviations = df.select(F.abs(value - F.lit(middle)).alias("deviation"))
    mad = exact_quantiles(deviations, ["deviation"], [0.5])["deviation"][0]
    if mad:
        return df.withColumn(output, F.lit(0.6745) * (value - middle) / mad)
    spread = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).first()
    if not spread["std"]:
        return df.withColumn(output, F.when(value.isNotNull(), F.lit(0.0)))
    return df.withColumn(output, (value - spread["mean"]) / spread["std"])


def robust_scaled(df: DataFrame, columns: list[str] = S.ANOMALY_FEATURES) -> DataFrame:
    """Centre on the median and divide by the interquartile range (1 when it is 0)."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    scaled = {}
    for c in columns:
        low, middle, high = quartiles[c]
        if middle is not None:
            scaled[c] = (F.col(c).cast("double") - F.lit(middle)) / F.lit((high - low) or 1.0)
    return df.withColumns(scaled)


def rule_thresholds(df: DataFrame, columns: list[str] = S.ANOMALY_FEATURES) -> dict[str, float]:
    """Strict limit per feature: the larger of q99 and q3 + 3 interquartile ranges."""
    found = exact_quantiles(df, columns, [0.25, 0.75, 0.99])
    return {
        c: max(top, high + 3.0 * (high - low))
        for c, (low, high, top) in found.items()
        if top is not None
    }


def with_reasons(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Reason list in feature order, then missing label, then idle row."""
    missing = S.MISSING_LABEL if S.MISSING_LABEL in df.columns else "false"
    volume = "Volume_activite" if "Volume_activite" in df.columns else "0"
    label_text = S.REASON_LABEL.replace("'", "\\'")
    reasons = [
        f"if({c} > {number_sql(limit)}, '{c}{S.REASON_HIGH}', null)"
        for c, limit in thresholds.items()
    ]
    reasons += [f"if({missing}, '{label_text}', null)", f"if({volume} = 0, '{S.REASON_IDLE}', null)"]
    listed = df.withColumn(REASON_LIST, F.expr(f"array_compact(array({', '.join(reasons)}))"))
    return listed.selectExpr(
        "*", f"array_join({REASON_LIST}, '; ') as {REASONS}", f"size({REASON_LIST}) > 0 as {RULE_FLAG}"
    )


def with_flags(df: DataFrame, decision: Column) -> DataFrame:
    """Score, model flag and final flag from the decision value (negative is unusual)."""
    return df.withColumns(
        {
            SCORE: round_half_even(-decision, 6),
            ML_FLAG: decision < 0,
            FLAG: (decision < 0) | F.col(RULE_FLAG),
        }
    )


def severity_cuts(df: DataFrame) -> tuple[float, float]:
    """Median and 80 % quantile of the flagged scores; 0 when nothing is flagged."""
    middle, high = exact_quantiles(df.where(F.col(FLAG)), [SCORE], [0.5, 0.8])[SCORE]
    return middle or 0.0, high or 0.0


def with_severity(df: DataFrame, cuts: tuple[float, float]) -> DataFrame:
    middle, high = cuts
    score = F.col(SCORE)
    level = (
        F.when(~F.col(FLAG), F.lit(S.LEVEL_NORMAL))
        .when(F.col(S.MISSING_LABEL) | (score >= high), F.lit(S.LEVEL_HIGH))
        .when(score >= middle, F.lit(S.LEVEL_MEDIUM))
        .otherwise(F.lit(S.LEVEL_LOW))
    )
    return df.withColumn(LEVEL, level)


def severity_split(df: DataFrame) -> DataFrame:
    return df.where(F.col(FLAG)).groupBy(LEVEL).agg(F.count("*").alias("nombre"))
