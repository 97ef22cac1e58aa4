import csv
import random

import pytest
from pyspark.errors import SparkRuntimeException

from tallyforge import schema as S
from tallyforge.operators.cleaning import clean, clean_with_quarantine
from tallyforge.operators.contracts import check_choice, check_limit, split_scoring_input
from tallyforge.sources.delimited import ROW_INDEX, read_delimited, rejected_lines, write_csv


def raw_row(spark, **changes):
    row = {S.PERIOD: "2026-S1", S.CATEGORY: "Test", S.LABEL: "Vol à main armée"}
    row |= dict.fromkeys(S.MEASURES, "0")
    row |= {"Saisine_Plaintes_directes": "02", "Saisine_FD": "-", "Saisine_ST": None, "Saisine_Autres": "1"}
    row |= {"Victimes_H": "1", "Victimes_F": "2", "MiseEnCause_Interpelles": "1", "Resultats_DEF": "1"}
    row |= changes
    fields = ", ".join(f"{name} string" for name in row)
    return spark.createDataFrame([tuple(row.values())], fields).selectExpr("*", f"0 as {ROW_INDEX}")


def test_one_row(spark):
    out = clean(raw_row(spark))
    assert out.columns == S.CLEAN_COLUMNS and len(out.columns) == 28
    row = out.first()
    assert (row.Saisine_Plaintes_directes, row.Saisine_FD, row.Total_victimes) == (2, 0, 3)
    assert (row.Total_saisines, row.Volume_activite, row.Total_resultats) == (3, 7, 1)
    assert (row.Plaintes_directes_annualisees, row.Facteur_annualisation) == (4, 2.0)
    assert row.Taux_DEF_sur_saisines == 0.3333
    assert row.Record_ID.startswith("INF-") and row.Observations_Objets_saisis == ""


def test_published_ids(spark):
    first = raw_row(spark, Annee="2024", Categorie="I. C/ ÉTAT", Infraction_Affaire_traitee="Vol de téléphone")
    assert clean(first).first().Record_ID == "INF-25E824897EAE"


@pytest.mark.parametrize(
    "label,kept",
    [("S/ TOTAL", False), ("total  général", True), ("TOTAL  GENERAL", False), ("TOTAL GENRAL", True), ("s/total x", False)],
)
def test_total_rows(spark, label, kept):
    assert clean(raw_row(spark, Infraction_Affaire_traitee=label)).count() == int(kept)


@pytest.mark.parametrize("label", [None, "", "  "])
def test_missing_label(spark, label):
    row = clean(raw_row(spark, Infraction_Affaire_traitee=label)).first()
    assert row.Infraction_non_renseignee
    if label is None:
        assert row.Infraction_normalisee == "infraction non renseignee"


def test_provided_label_wins_unless_blank(spark):
    assert clean(raw_row(spark, Infraction_normalisee="Été")).first().Infraction_normalisee == "ete"
    assert clean(raw_row(spark, Infraction_normalisee=" ")).first().Infraction_normalisee == "vol a main armee"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Saisine_FD.*Victimes_H"):
        clean(raw_row(spark).drop("Victimes_H", "Saisine_FD"))


def test_invalid_count_fails_or_is_set_aside(spark):
    bad = raw_row(spark, Victimes_H="-3", Resultats_DAT="abc")
    with pytest.raises(SparkRuntimeException, match="invalid count"):
        clean(bad).collect()
    good, aside = clean_with_quarantine(bad.unionByName(raw_row(spark)))
    assert good.count() == 1
    assert aside.first().invalid_counts == ["Victimes_H", "Resultats_DAT"]


def test_whole_number_columns_are_checked_too(spark):
    typed = raw_row(spark).selectExpr(
        "* except (Victimes_H)", "-1L as Victimes_H"
    )
    with pytest.raises(SparkRuntimeException, match="invalid count"):
        clean(typed).collect()


def test_delimited_scan(spark, tmp_path):
    lines = ["a;b;c", "1;x;NA", "2;y", "3;z;w;extra", '4;"q;r";s', "", "5;;null"]
    (tmp_path / "messy.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    rows = read_delimited(spark, str(tmp_path / "messy.csv")).orderBy(ROW_INDEX).collect()
    assert [tuple(r) for r in rows] == [
        ("1", "x", None, 0), ("2", "y", None, 1), ("4", "q;r", "s", 2), ("5", None, None, 3),
    ]


def test_row_index_is_dense_over_file_splits(spark, tmp_path):
    path = str(tmp_path / "parts")
    write_csv(spark.range(0, 1000, 1, 5).selectExpr("id", "id * 2 as b"), path, sep=";")
    found = read_delimited(spark, path).collect()
    assert sorted(r[ROW_INDEX] for r in found) == list(range(1000))
    ordered = sorted(found, key=lambda r: r[ROW_INDEX])
    assert [int(r.id) for r in ordered] == sorted(int(r.id) for r in ordered)


def test_scoring_contract(spark):
    given = spark.createDataFrame(
        [(1, "C0", 3, None), (2, "C1", -1, "2024"), (3, None, 0, "2024")],
        "n int, categorie string, saisine_fd long, annee string",
    )
    valid, rejected = split_scoring_input(given)
    row = valid.first()
    assert (row.n, row.Annee, row.Saisine_FD, row.Victimes_H) == (1, "2026-S1", 3, 0)
    assert sorted(r.n for r in rejected.collect()) == [2, 3]


def test_parameter_bounds():
    assert check_limit(1000, 1000) == 1000
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            check_limit(limit, 1000)
    with pytest.raises(ValueError, match="plaintes"):
        check_choice("x", ["plaintes"])


def test_line_ends_in_quotes_and_rejected_lines(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('a;b\n1;"x\ny"\n2;z\n3;4;5\n', encoding="utf-8")
    rows = read_delimited(spark, str(path), line_ends_in_quotes=True).orderBy(ROW_INDEX).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "x\ny"), ("2", "z")]
    rejected = rejected_lines(spark, str(path), line_ends_in_quotes=True).collect()
    assert [r.line for r in rejected] == ["3;4;5"] and rejected[0].file.endswith("quoted.csv")


def test_quoted_line_ends_run_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    values = ["", "x", "NA", 'say "no"', "a;b", "two\nlines", '"\n;"\n', ";\n\n;", 'end"', "\r\nz", "long " * 40 + "\n" + "w" * 90]
    rows = [[str(i), rng.choice(values), rng.choice(values)] for i in range(600)]
    path = tmp_path / "quoted"
    path.mkdir()
    for part in range(3):
        with open(path / f"part-{part}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, delimiter=";", lineterminator="\r\n" if part == 1 else "\n")
            writer.writerow(["n", "a b", "c`d"])
            writer.writerows(rows[part * 200 : part * 200 + 200])
            out.write('\n9000;5" wide;x\n' if part == 2 else "")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        found = read_delimited(spark, str(path), line_ends_in_quotes=True).orderBy(ROW_INDEX).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    expected = [[None if v in ("", "NA") else v for v in row] for row in [*rows, ["9000", '5" wide', "x"]]]
    assert [list(r)[:3] for r in found] == expected
    assert [r[ROW_INDEX] for r in found] == list(range(601))
