"""The query set behind the dashboard views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.numbers import round_sql
from tallyforge.operators import reconcile as rec, serving as serve
from tallyforge.runtime import materialize
from tallyforge.schema import ALL_VALUES

KEYS = ["annee", "categorie", "infraction", "cluster"]
SUMMED = ["saisine_plaintes_directes", "total_saisines", "total_victimes", "interpelles", "resultats_def"]
_AVERAGED = {
    "moyenne_saisines": "total_saisines",
    "moyenne_victimes": "total_victimes",
    "moyenne_interpelles": "interpelles",
    "moyenne_resultats_def": "resultats_def",
}


def condense(served: DataFrame) -> DataFrame:
    """Sums, rows, flagged rows and known values per period, category, label and cluster.

    One pass that pre-aggregates on the map side. The sums keep the names of the columns they
    add up, so what sums or lists served rows may read these cells in their place.
    """
    return served.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMMED],
        F.count("*").alias("lignes"),
        F.count_if("est_anomalie").alias("anomalies"),
        *[F.count(c).alias(f"connus_{c}") for c in _AVERAGED.values()],
    )


def _summary(cells: DataFrame, annee: str | None, categorie: str | None) -> DataFrame:
    sums = {
        "lignes": "lignes",
        "plaintes_directes": "saisine_plaintes_directes",
        "total_saisines": "total_saisines",
        "victimes": "total_victimes",
        "interpelles": "interpelles",
        "resultats_def": "resultats_def",
        "anomalies": "anomalies",
    }
    totals = serve.with_filters(cells, annee, categorie).agg(
        *[F.expr(f"coalesce(sum({c}), 0) as {name}") for name, c in sums.items()]
    )
    return totals.select(
        F.lit(annee or ALL_VALUES).alias("annee"), F.lit(categorie or ALL_VALUES).alias("categorie"), *totals.columns
    )


def _cluster_averages(cells: DataFrame) -> DataFrame:
    def mean(column: str) -> str:
        return round_sql(f"coalesce(sum({column}) / nullif(sum(connus_{column}), 0), 0D)", 2)

    averages = [F.expr(f"{mean(c)} as {name}") for name, c in _AVERAGED.items()]
    known = cells.where(F.col("cluster").isNotNull()).groupBy("cluster")
    return known.agg(F.sum("lignes").alias("nombre_lignes"), *averages).orderBy("cluster")


def feeds(
    served: DataFrame,
    reconciliation: DataFrame,
    annee: str | None = None,
    categorie: str | None = None,
    niveau: str | None = None,
) -> dict[str, DataFrame]:
    """One frame per view.

    The six views of sums and values read stored cells, for which ``served`` is read once; the
    two row lists without filters are one stored list of at most 1,000 rows. The list of
    flagged rows reads ``served`` when it is read itself.
    """
    cells = materialize(condense(served), "feed_cells")
    listed = materialize(serve.listing(served, limit=1000), "feed_rows")
    records = serve.listing(served, annee, categorie, limit=1000) if annee or categorie else listed
    return {
        "annees": serve.distinct_values(cells, "annee"),
        "categories": serve.distinct_values(cells, "categorie"),
        "resume": _summary(cells, annee, categorie),
        "principales_infractions": serve.top_labels(cells, annee=annee),
        "comparaison_periodes": serve.statistics_by_period(cells),
        "donnees_filtrees": records,
        "nuage_clusters": serve.cluster_points(listed),
        "profil_clusters": _cluster_averages(cells),
        "anomalies": serve.anomaly_listing(served, niveau, limit=500),
        "ecarts": rec.mismatches(reconciliation),
    }


def contents(views: dict[str, DataFrame]) -> DataFrame:
    """(vue, cle, valeurs, reel_1 to reel_4): the rows of all views in one shape.

    ``cle`` joins the texts of a row and ``valeurs`` everything else that is no fraction, in
    the view's order of columns and without nulls; fractions keep their type.
    """
    rows = []
    for name, frame in views.items():
        texts = [c for c, kind in frame.dtypes if kind == "string"]
        reals = [c for c, kind in frame.dtypes if kind == "double"]
        others = [F.col(c).cast("string") for c, _ in frame.dtypes if c not in texts + reals]
        rows.append(frame.select(
            F.lit(name).alias("vue"),
            F.concat_ws("|", *texts).alias("cle"),
            F.concat_ws("|", *others).alias("valeurs"),
            *[(F.col(reals[i]) if i < len(reals) else F.lit(None).cast("double")).alias(f"reel_{i + 1}") for i in range(4)],
        ))
    out = rows[0]
    for frame in rows[1:]:
        out = out.unionByName(frame)
    return out
