import pytest
from pyspark.sql import functions as F

from tallyforge.operators import serving as serve
from tallyforge.plans import dashboard
from tallyforge.schema import SERVING_COLUMNS

RECON = "Annee string, Indicateur string, Total_detail long, Total_officiel long, Ecart long, Concordance boolean"


@pytest.fixture(scope="module")
def served(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("r"), "id").alias("Record_ID"),
        F.expr("if(id % 13 = 0, null, concat('20', 20 + id % 3))").alias("Annee"),
        F.expr("concat('c', id % 4)").alias("Categorie"),
        F.expr("if(id % 11 = 0, '', concat('label ', id % 25))").alias("Infraction_normalisee"),
        *[F.expr(f"if(id % {7 + i} = 0, null, id * {i + 3} % 41)").alias(c) for i, c in enumerate(
            ["Saisine_Plaintes_directes", "Total_saisines", "Total_victimes", "MiseEnCause_Interpelles", "Resultats_DEF"])],
        F.expr("if(id % 5 = 0, null, id % 3)").alias("Cluster"),
        F.expr("if(id % 9 = 0, null, id / 7D)").alias("PCA_1"),
        F.expr("id / 3D").alias("PCA_2"),
        F.expr("id % 6 = 0").alias("Est_anomalie"),
    )
    for source, kind in SERVING_COLUMNS.values():
        if source not in rows.columns:
            rows = rows.withColumn(source, F.lit(None).cast(kind))
    return serve.to_serving(rows)


@pytest.mark.parametrize("annee, categorie", [(None, None), ("2021", None), ("2021", "c1"), ("1900", "none")])
def test_views_from_cells_equal_those_from_rows(spark, served, annee, categorie):
    views = dashboard.feeds(served, spark.createDataFrame([], RECON), annee, categorie)
    direct = {
        "annees": serve.distinct_values(served, "annee"),
        "categories": serve.distinct_values(served, "categorie"),
        "resume": serve.summary(served, annee, categorie),
        "principales_infractions": serve.top_labels(served, annee=annee),
        "comparaison_periodes": serve.statistics_by_period(served),
        "donnees_filtrees": serve.listing(served, annee, categorie, limit=1000),
        "nuage_clusters": serve.cluster_points(serve.listing(served, limit=1000)),
        "profil_clusters": serve.cluster_averages(served),
    }
    for name, frame in direct.items():
        assert views[name].columns == frame.columns
        assert sorted(map(str, views[name].collect())) == sorted(map(str, frame.collect())), name


def test_views_of_sums_never_read_the_rows(spark, served):
    views = dashboard.feeds(served, spark.createDataFrame([], RECON))
    for name in ("annees", "resume", "principales_infractions", "comparaison_periodes", "profil_clusters"):
        assert views[name].inputFiles() and all("feed_cells" in file for file in views[name].inputFiles())


def test_an_empty_table_has_empty_views_and_a_summary_of_zeros(spark, served):
    views = dashboard.feeds(served.limit(0), spark.createDataFrame([], RECON))
    rows = dashboard.contents(views).collect()
    assert [(r.vue, r.valeurs) for r in rows] == [("resume", "0|0|0|0|0|0|0")]
