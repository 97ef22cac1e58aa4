"""Data quality report, audit rows and missing-value profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import round_sql
from tallyforge.operators.reconcile import MATCH
from tallyforge.operators.reshape import long_rows, one_row
from tallyforge.runtime import materialize


def counts_by_period_and_category(clean: DataFrame) -> DataFrame:
    """Rows per period and per category.

    Rows are counted per (period, category) first, so the grouping sets expand a handful
    of counts and not the table.
    """
    pairs = clean.groupBy(S.PERIOD, S.CATEGORY).agg(F.count("*").alias("n"))
    grouped = pairs.groupingSets(
        [[F.col(S.PERIOD)], [F.col(S.CATEGORY)]], F.col(S.PERIOD), F.col(S.CATEGORY)
    ).agg(F.sum("n").alias("nombre"), F.grouping(S.PERIOD).alias("_category_row"))
    return grouped.selectExpr(
        f"if(_category_row = 1, '{S.CATEGORY}', '{S.PERIOD}') as dimension",
        f"if(_category_row = 1, {S.CATEGORY}, {S.PERIOD}) as valeur",
        "nombre",
    )


def _by_label(clean: DataFrame) -> DataFrame:
    """Partial report per (period, category, label), the only pass over the measures.

    It is stored, because every figure of the report but the duplicates is drawn from it.
    """
    negatives = " + ".join(f"cast({c} < 0 as bigint)" for c in S.MEASURES)
    partial = clean.groupBy(S.PERIOD, S.CATEGORY, S.NORMALISED).agg(
        F.expr("count(*) as rows"),
        F.expr(f"count_if({S.MISSING_LABEL}) as missing"),
        F.expr(f"sum({negatives}) as negatives"),
        F.expr("count_if(Volume_activite = 0) as idle"),
    )
    return materialize(partial, "by_label")


def _scalars(by_label: DataFrame, clean: DataFrame) -> list[DataFrame]:
    """One-row frames of the scalar checks.

    Each distinct count groups on its own key with map-side combine. Asking for all of
    them in one aggregate would multiply every input row by the number of distinct keys.
    """
    totals = by_label.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("nombre_lignes"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("labels_non_renseignes"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("valeurs_negatives"),
        F.coalesce(F.sum("idle"), F.lit(0)).alias("lignes_sans_activite"),
    )
    distinct = [
        by_label.groupBy(column).count().agg(F.count("*").alias(name))
        for column, name in [
            (S.PERIOD, "nombre_periodes"),
            (S.CATEGORY, "nombre_categories"),
            (S.NORMALISED, "nombre_infractions_normalisees"),
        ]
    ]
    repeats = clean.groupBy(S.RECORD_ID).count()
    duplicates = repeats.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("doublons_record_id")
    )
    return [totals, *distinct, duplicates]


def quality_report(clean: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """One-row report; the two maps hold one entry per period and per category."""
    by_label = _by_label(clean)

    def tally(column: str, name: str) -> DataFrame:
        per_value = by_label.groupBy(column).agg(F.sum("rows").alias("n"))
        entries = F.sort_array(F.collect_list(F.struct(column, "n")))
        return per_value.agg(F.map_from_entries(entries).alias(name))

    gaps = reconciliation.agg(F.count_if(~F.col(MATCH)).alias("ecarts_avec_totaux_officiels"))
    periods = by_label.select(S.PERIOD).distinct()
    report = one_row(
        [
            *_scalars(by_label, clean),
            periods.agg(F.sort_array(F.collect_list(S.PERIOD)).alias("periodes")),
            tally(S.PERIOD, "lignes_par_periode"),
            tally(S.CATEGORY, "lignes_par_categorie"),
            gaps,
        ]
    )
    return report.withColumn("nombre_colonnes", F.lit(len(clean.columns)).cast("long"))


def audit_rows(clean: DataFrame) -> DataFrame:
    """The eight audit scalars as (indicator, value) rows."""
    wide = one_row(_scalars(_by_label(clean), clean)).withColumn(
        "nombre_colonnes", F.lit(len(clean.columns)).cast("long")
    )
    names = [
        "nombre_lignes",
        "nombre_colonnes",
        "nombre_periodes",
        "nombre_categories",
        "nombre_infractions_normalisees",
        "labels_non_renseignes",
        "lignes_sans_activite",
        "doublons_record_id",
    ]
    return long_rows(wide, [], [{"indicateur": f"'{n}'", "valeur": n} for n in names])


def missing_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and share per column, most incomplete first."""
    wide = df.agg(
        F.expr("count(*) as _rows"),
        *[F.expr(f"count_if(`{c}` is null) as `{c}`") for c in df.columns],
    )
    share = [
        {
            "colonne": f"'{c}'",
            "nombre_manquant": f"`{c}`",
            "pourcentage": round_sql(f"100 * `{c}` / nullif(_rows, 0)", 2),
        }
        for c in df.columns
    ]
    rows = long_rows(wide, [], share)
    if only_missing:
        rows = rows.where(F.col("nombre_manquant") > 0)
    return rows.orderBy(F.col("nombre_manquant").desc(), "colonne")
