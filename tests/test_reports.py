import pytest

from tallyforge import schema as S
from tallyforge.operators import quality, reconcile as rec, serving as serve
from tallyforge.operators.cleaning import clean
from tallyforge.operators.documents import flatten_results
from tallyforge.plans import registry
from tallyforge.sources.delimited import ROW_INDEX
from tallyforge.sources.documents import read_document, write_document
from tallyforge.sources.tables import StageMissing, load_serving_table, read_prepared, write_table


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [
        (period, category, label, *[(i + j) % 4 for j in range(14)], i)
        for i, (period, category, label) in enumerate(
            [("2024", "A", "Vol"), ("2024", "A", "Vol"), ("2024", "B", None), ("2025", "A", "Rixe")]
        )
    ]
    fields = ", ".join(f"{c} string" for c in (S.PERIOD, S.CATEGORY, S.LABEL))
    counts = ", ".join(f"{c} long" for c in S.MEASURES)
    return clean(spark.createDataFrame(rows, f"{fields}, {counts}, {ROW_INDEX} long")).cache()


def official(spark, *rows):
    return spark.createDataFrame(rows, "Annee string, Saisine_FD string, Victimes_H string")


def test_reconcile(spark, cleaned):
    given = official(spark, (" 2024 ", "06", "-"), ("1999", "5", "5"))
    found = {r.Indicateur: r for r in rec.reconcile(cleaned, given).collect()}
    assert len(found) == 14 and {r.Annee for r in found.values()} == {"2024"}
    row = found["Saisine_FD"]
    assert (row.Total_detail, row.Total_officiel, row.Ecart, row.Concordance) == (6, 6, 0, True)
    assert found["Saisine_ST"].Total_officiel == 0
    gaps = rec.largest_gaps(rec.reconcile(cleaned, given)).collect()
    assert [abs(r.Ecart) for r in gaps] == sorted((abs(r.Ecart) for r in gaps), reverse=True)


def test_reconcile_without_official_totals(cleaned):
    empty = rec.reconcile(cleaned, None)
    assert empty.count() == 0
    assert quality.quality_report(cleaned, empty).first().ecarts_avec_totaux_officiels == 0


def test_gap_matrix_fills_absent_periods(spark, cleaned):
    matrix = rec.gap_matrix(rec.reconcile(cleaned, official(spark, ("2024", "6", "0"))), ["2024", "2025"])
    assert matrix.columns == ["Indicateur", "2024", "2025"]
    assert {r["2025"] for r in matrix.collect()} == {0}


def test_quality_report(cleaned):
    row = quality.quality_report(cleaned, rec.reconcile(cleaned, None)).first()
    assert (row.nombre_lignes, row.nombre_colonnes, row.nombre_categories) == (4, 28, 2)
    assert (row.labels_non_renseignes, row.doublons_record_id, row.valeurs_negatives) == (1, 0, 0)
    assert row.periodes == ["2024", "2025"] and row.lignes_par_periode == {"2024": 3, "2025": 1}
    assert row.lignes_par_categorie == {"A": 3, "B": 1}
    doubled = cleaned.unionByName(cleaned)
    assert quality.quality_report(doubled, rec.reconcile(doubled, None)).first().doublons_record_id == 4


def test_report_of_an_empty_table(cleaned):
    none = cleaned.limit(0)
    row = quality.quality_report(none, rec.reconcile(none, None)).first()
    assert (row.nombre_lignes, row.nombre_categories, row.doublons_record_id) == (0, 0, 0)
    assert serve.summary(serve.to_serving(none)).first().plaintes_directes == 0


def test_missing_profile(cleaned):
    gaps = quality.missing_profile(cleaned.selectExpr("*", "nullif(Categorie, 'A') as seule"), only_missing=True)
    assert [tuple(r) for r in gaps.collect()] == [("seule", 3, 75.0)]


def test_serving_defaults(cleaned):
    served = serve.to_serving(cleaned)
    assert served.columns == list(S.SERVING_COLUMNS)
    row = served.first()
    assert (row.niveau_anomalie, row.raisons_anomalie, row.est_anomalie, row.cluster) == ("Normale", "", False, None)
    listing = serve.listing(served, limit=2).collect()
    assert listing[0].plaintes_directes >= listing[1].plaintes_directes
    with pytest.raises(ValueError):
        serve.listing(served, limit=1001)
    with pytest.raises(ValueError):
        serve.top_labels(served, "prix")


def test_false_and_zero_are_filters(cleaned):
    served = serve.to_serving(registry.standin_enriched(cleaned))
    assert serve.listing(served, anomalie=False).where("est_anomalie").count() == 0
    assert {r.cluster for r in serve.listing(served, cluster=0).collect()} <= {0}


def test_documents_and_tables(spark, cleaned, tmp_path):
    report = quality.quality_report(cleaned, rec.reconcile(cleaned, None))
    path = str(tmp_path / "report")
    write_document(report, path)
    assert read_document(spark, path, "absent").first().nombre_lignes == 4
    with pytest.raises(StageMissing, match="absent"):
        read_document(spark, str(tmp_path / "none"), "absent")
    write_table(cleaned, str(tmp_path / "clean"), [S.PERIOD])
    assert read_prepared(spark, str(tmp_path / "clean"), "absent").count() == 4
    with pytest.raises(StageMissing):
        read_prepared(spark, str(tmp_path / "none"), "absent")


def test_serving_load_skips_a_filled_table(cleaned):
    served = serve.to_serving(cleaned)
    assert load_serving_table(served, "load_test") == 4
    assert load_serving_table(served.limit(1), "load_test") == 4
    assert load_serving_table(served.limit(1), "load_test", force=True) == 1


def test_flatten(spark):
    nested = spark.sql("select 'm' as modele, named_struct('mae', 1D, 'r2', 2D) as validation_kfold, named_struct('mae', 3D) as validation_par_periode, 4D as mae_entrainement")
    assert flatten_results(nested).first().asDict() == {
        "modele": "m", "kfold_mae": 1.0, "kfold_r2": 2.0, "periode_mae": 3.0, "mae_entrainement": 4.0,
    }


def test_served_filters_read_one_partition(spark):
    rows = spark.range(60).selectExpr("id", "cast(2020 + id % 3 as string) as annee")
    assert load_serving_table(rows, "partition_test") == 60
    found = spark.table("partition_test").where("annee = '2021'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(annee" in plan and found.count() == 20
    spark.sql("drop table partition_test")


def test_json_document_sums_the_facts_once_for_its_cells(spark, tmp_path, monkeypatch):
    """One reading of the order lines for the cells, one for the official totals."""
    from tallyforge.plans import registry
    from tallyforge.sources import cells

    lines = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double, l_shipdate date"
    orders = "o_orderkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"
    day = __import__("datetime").date
    made = {
        "lineitem": ([(i % 4, i % 3, 2.0 + i, "ARN"[i % 3], "FO"[i % 2], 0.01 * i, 0.08, day(1999, 5, 1 + i)) for i in range(9)], lines),
        "orders": ([(i, "FOP"[i % 3], day(1997 + i, 1, 1), "1-URGENT") for i in range(4)], orders),
        "part": ([(i, f"type {i}", f"name {i}") for i in range(3)], "p_partkey long, p_type string, p_name string"),
    }
    for name, (rows, shape) in made.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    read, facts = [], cells.fact_rows
    monkeypatch.setattr(cells, "fact_rows", lambda *given: read.append(1) or facts(*given))
    (row,) = registry.s4_json_document(spark, str(tmp_path)).collect()
    assert len(read) == 2
    assert row.nombre_lignes == cells.coarse_cells(spark, str(tmp_path)).count() and row.doublons_record_id == 0
