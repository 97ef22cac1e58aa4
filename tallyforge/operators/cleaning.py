"""Raw rows to the 28-column activity table, as one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import count_sql, ratio_sql, round_sql, total_sql
from tallyforge.functions.text import normalize_label, trim_unicode
from tallyforge.operators.contracts import require_columns
from tallyforge.sources.delimited import ROW_INDEX

INVALID = "invalid_counts"


def or_default_text(value: Column, default: str) -> Column:
    return trim_unicode(F.coalesce(value.cast("string"), F.lit(default)))


def label_is_missing(value: Column) -> Column:
    return value.isNull() | (trim_unicode(value) == "")


def is_total_row(label: Column) -> Column:
    return F.upper(label).rlike(r"(?U)S/\s*TOTAL|TOTAL\s+GENERAL")


def resolve_normalised(label: Column, provided: Column | None) -> Column:
    """The provided normalised label unless blank; either one is normalised."""
    if provided is None:
        return normalize_label(label)
    given = trim_unicode(F.coalesce(provided.cast("string"), F.lit("")))
    return normalize_label(F.when(given == "", label).otherwise(given))


STABLE_ID = (
    f"concat('INF-', upper(substring(sha1(concat_ws('|', {S.PERIOD}, {S.CATEGORY}, "
    f"{S.NORMALISED}, cast(_ordinal as string))), 1, 12)))"
)


def factor_sql(factors: dict[str, float]) -> str:
    """Annualisation factor of the period; unlisted periods count once."""
    cases = " ".join(f"when '{name}' then {factor}D" for name, factor in factors.items())
    return f"case {S.PERIOD} {cases} else 1D end" if cases else "1D"


def _prepared(df: DataFrame, ordinal: str, strict: bool) -> DataFrame:
    require_columns(df, [*S.REQUIRED, ordinal])
    provided = F.col(S.NORMALISED) if S.NORMALISED in df.columns else None
    if S.OBSERVATIONS in df.columns:
        observations = F.coalesce(F.col(S.OBSERVATIONS).cast("string"), F.lit(""))
    else:
        observations = F.lit("")
    label = or_default_text(F.col(S.LABEL), S.UNKNOWN_LABEL)
    rows = df.where(~is_total_row(label))
    invalid = ", ".join(
        f"if({count_sql(df, c, strict=False)} is null, '{c}', null)" for c in S.MEASURES
    )
    return rows.select(
        or_default_text(F.col(S.PERIOD), S.UNKNOWN_PERIOD).alias(S.PERIOD),
        or_default_text(F.col(S.CATEGORY), S.UNKNOWN_CATEGORY).alias(S.CATEGORY),
        label.alias(S.LABEL),
        resolve_normalised(label, provided).alias(S.NORMALISED),
        *[F.expr(f"{count_sql(df, c, strict)} as {c}") for c in S.MEASURES],
        label_is_missing(F.col(S.LABEL)).alias(S.MISSING_LABEL),
        observations.alias(S.OBSERVATIONS),
        F.col(ordinal).alias("_ordinal"),
        *([] if strict else [F.expr(f"array_compact(array({invalid})) as {INVALID}")]),
    )


def _derived(rows: DataFrame, factors: dict[str, float]) -> DataFrame:
    totals = rows.selectExpr(
        "*",
        f"{total_sql(S.INTAKE)} as Total_saisines",
        f"{total_sql(S.VICTIMS)} as Total_victimes",
        f"{total_sql(S.OUTCOMES)} as Total_resultats",
        f"{factor_sql(factors)} as Facteur_annualisation",
    )
    complaints = "Saisine_Plaintes_directes * Facteur_annualisation"
    return totals.selectExpr(
        "*",
        f"{total_sql(['Total_saisines', 'Total_victimes', *S.IMPLICATED])} as Volume_activite",
        f"{ratio_sql(S.TARGET, 'Total_saisines')} as Taux_DEF_sur_saisines",
        f"cast({round_sql(complaints)} as bigint) as {S.ANNUALISED}",
        f"{STABLE_ID} as {S.RECORD_ID}",
    )


def clean(
    df: DataFrame,
    ordinal: str = ROW_INDEX,
    factors: dict[str, float] | None = None,
) -> DataFrame:
    """Clean table; an invalid count fails the job.

    ``ordinal`` names a column that tells rows with the same period, category and label
    apart: the line position for files, a natural key for derived tables.
    """
    rows = _prepared(df, ordinal, strict=True)
    return _derived(rows, S.HALF_YEAR_FACTORS if factors is None else factors).select(
        *S.CLEAN_COLUMNS
    )


def clean_with_quarantine(
    df: DataFrame,
    ordinal: str = ROW_INDEX,
    factors: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean table and the rows whose counts could not be read, with the column names."""
    rows = _prepared(df, ordinal, strict=False)
    good = _derived(
        rows.where(F.size(INVALID) == 0), S.HALF_YEAR_FACTORS if factors is None else factors
    )
    bad = rows.where(F.size(INVALID) > 0)
    return good.select(*S.CLEAN_COLUMNS), bad.withColumnRenamed("_ordinal", ordinal)
