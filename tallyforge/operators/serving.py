"""Filtered summaries, rankings and listings over the serving table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.numbers import round_sql
from tallyforge.functions.text import truthy_sql
from tallyforge.operators.contracts import check_choice, check_limit
from tallyforge.schema import ALL_VALUES, LEVEL_NORMAL, SERVING_COLUMNS

# The metrics that may be ranked, and the output names below.
TOP_METRICS = {
    "plaintes_directes": "saisine_plaintes_directes",
    "victimes": "total_victimes",
    "interpelles": "interpelles",
    "resultats_def": "resultats_def",
}
_TEXT_DEFAULTS = {
    "niveau_anomalie": LEVEL_NORMAL,
    "raisons_anomalie": "",
    "observations": "",
}


def to_serving(enriched: DataFrame) -> DataFrame:
    """Rename, cast and default the enriched columns to the serving schema."""

    def column(name: str, source: str, kind: str) -> str:
        default = _TEXT_DEFAULTS.get(name)
        if source not in enriched.columns:
            value = "false" if kind == "boolean" else "null" if default is None else f"'{default}'"
        elif kind == "boolean":
            value = truthy_sql(source)
        elif default is not None:
            value = f"coalesce(cast({source} as string), '{default}')"
        else:
            value = source
        return f"cast({value} as {kind}) as {name}"

    return enriched.selectExpr(*[column(n, s, k) for n, (s, k) in SERVING_COLUMNS.items()])


def with_filters(df: DataFrame, annee: str | None = None, categorie: str | None = None) -> DataFrame:
    """Equality filters; an empty value means no filter."""
    if annee:
        df = df.where(F.col("annee") == annee)
    if categorie:
        df = df.where(F.col("categorie") == categorie)
    return df


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("lignes_en_base"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def _sums(metrics: dict[str, str]) -> list[Column]:
    return [F.expr(f"coalesce(sum({c}), 0) as {name}") for name, c in metrics.items()]


def summary(df: DataFrame, annee: str | None = None, categorie: str | None = None) -> DataFrame:
    totals = with_filters(df, annee, categorie).agg(
        F.count("*").alias("lignes"),
        *_sums(
            {
                "plaintes_directes": "saisine_plaintes_directes",
                "total_saisines": "total_saisines",
                "victimes": "total_victimes",
                "interpelles": "interpelles",
                "resultats_def": "resultats_def",
            }
        ),
        F.count_if("est_anomalie").alias("anomalies"),
    )
    return totals.select(
        F.lit(annee or ALL_VALUES).alias("annee"),
        F.lit(categorie or ALL_VALUES).alias("categorie"),
        *totals.columns,
    )


def statistics_by_period(df: DataFrame) -> DataFrame:
    return df.groupBy("annee").agg(*_sums(TOP_METRICS)).orderBy("annee")


def top_labels(
    df: DataFrame, metric: str = "plaintes_directes", annee: str | None = None, limit: int = 15
) -> DataFrame:
    column = TOP_METRICS[check_choice(metric, TOP_METRICS)]
    ranked = with_filters(df, annee).groupBy("infraction").agg(*_sums({"valeur": column}))
    return ranked.orderBy(F.col("valeur").desc(), "infraction").limit(check_limit(limit, 50))


def cluster_averages(df: DataFrame) -> DataFrame:
    averages = {
        "moyenne_saisines": "total_saisines",
        "moyenne_victimes": "total_victimes",
        "moyenne_interpelles": "interpelles",
        "moyenne_resultats_def": "resultats_def",
    }
    return (
        df.where(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(
            F.expr("count(*) as nombre_lignes"),
            *[
                F.expr(f"{round_sql(f'coalesce(avg({c}), 0D)', 2)} as {name}")
                for name, c in averages.items()
            ],
        )
        .orderBy("cluster")
    )


def listing(
    df: DataFrame,
    annee: str | None = None,
    categorie: str | None = None,
    cluster: int | None = None,
    anomalie: bool | None = None,
    limit: int = 200,
) -> DataFrame:
    """Rows with most complaints first; zero and false are real filters here."""
    rows = with_filters(df, annee, categorie)
    if cluster is not None:
        rows = rows.where(F.col("cluster") == cluster)
    if anomalie is not None:
        rows = rows.where(F.col("est_anomalie") == anomalie)
    return (
        rows.selectExpr(
            "record_id",
            "annee",
            "categorie",
            "infraction",
            "saisine_plaintes_directes as plaintes_directes",
            "total_saisines",
            "total_victimes as victimes",
            "interpelles",
            "resultats_def",
            "cluster",
            "pca_1",
            "pca_2",
            "est_anomalie",
            "niveau_anomalie",
            "score_anomalie",
            "raisons_anomalie",
        )
        .orderBy(F.col("plaintes_directes").desc(), "record_id")
        .limit(check_limit(limit, 1000))
    )


def anomaly_listing(df: DataFrame, niveau: str | None = None, limit: int = 100) -> DataFrame:
    rows = df.where("est_anomalie")
    if niveau:
        rows = rows.where(F.col("niveau_anomalie") == niveau)
    return (
        rows.selectExpr(
            "record_id",
            "annee",
            "categorie",
            "infraction",
            "niveau_anomalie as niveau",
            "score_anomalie as score",
            "raisons_anomalie as raisons",
            "saisine_plaintes_directes as plaintes_directes",
            "total_victimes as victimes",
            "interpelles",
        )
        .orderBy(F.col("score").desc_nulls_last(), "record_id")
        .limit(check_limit(limit, 500))
    )


def cluster_points(df: DataFrame) -> DataFrame:
    """Listing rows that can be drawn: cluster and both coordinates known."""
    return df.dropna(subset=["pca_1", "pca_2", "cluster"])
