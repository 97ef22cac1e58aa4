"""Reconciliation of the detail against official totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.functions.numbers import count_sql, round_half_even
from tallyforge.functions.text import trim_unicode
from tallyforge.operators.reshape import long_rows
from tallyforge.schema import MEASURES, PERIOD

INDICATOR = "Indicateur"
DETAIL = "Total_detail"
OFFICIAL = "Total_officiel"
GAP = "Ecart"
MATCH = "Concordance"

SCHEMA = T.StructType(
    [
        T.StructField(PERIOD, T.StringType()),
        T.StructField(INDICATOR, T.StringType()),
        T.StructField(DETAIL, T.LongType()),
        T.StructField(OFFICIAL, T.LongType()),
        T.StructField(GAP, T.LongType()),
        T.StructField(MATCH, T.BooleanType()),
    ]
)


def sums_by_period(clean: DataFrame, columns: list[str] = MEASURES) -> DataFrame:
    return clean.groupBy(PERIOD).agg(*[F.expr(f"sum({c}) as {c}") for c in columns])


def reconcile(clean: DataFrame, official: DataFrame | None) -> DataFrame:
    """Gap per period and measure; periods known to one side only are left out.

    The detail is summed per period before the join, so the join sees one row per period
    on each side; its strategy is left to the optimizer.
    """
    if official is None:
        return clean.sparkSession.createDataFrame([], SCHEMA)
    given = official.select(
        trim_unicode(F.col(PERIOD)).alias(PERIOD),
        *[
            F.expr(f"{count_sql(official, c) if c in official.columns else '0L'} as official_{c}")
            for c in MEASURES
        ],
    )
    joined = sums_by_period(clean).join(given, PERIOD)
    compared = long_rows(
        joined,
        [PERIOD],
        [
            {INDICATOR: f"'{c}'", DETAIL: c, OFFICIAL: f"official_{c}"}
            for c in MEASURES
        ],
    )
    return compared.selectExpr(
        "*", f"{DETAIL} - {OFFICIAL} as {GAP}", f"{DETAIL} = {OFFICIAL} as {MATCH}"
    )


def mismatches(reconciliation: DataFrame) -> DataFrame:
    return reconciliation.where(~F.col(MATCH))


def largest_gaps(reconciliation: DataFrame) -> DataFrame:
    return mismatches(reconciliation).orderBy(F.abs(GAP).desc(), PERIOD, INDICATOR)


def gap_matrix(reconciliation: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """Indicators by periods; naming the periods saves the job that lists them."""
    grouped = reconciliation.groupBy(INDICATOR)
    pivoted = grouped.pivot(PERIOD, periods) if periods else grouped.pivot(PERIOD)
    return pivoted.agg(F.first(GAP)).na.fill(0)


def concordance_rate(reconciliation: DataFrame) -> DataFrame:
    matching = F.count_if(F.col(MATCH))
    return reconciliation.agg(
        F.count("*").alias("comparaisons"),
        F.count_if(~F.col(MATCH)).alias("ecarts"),
        round_half_even(matching / F.nullif(F.count("*"), F.lit(0)), 4).alias("taux_concordance"),
    )
