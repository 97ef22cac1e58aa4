import pytest
from pyspark.sql import functions as F

from tallyforge.sources.tables import load_serving_table, swap_partitions

SCHEMA = "record_id string, annee string, plaintes long"
ROWS = [("a", "2023", 1), ("b", "2023", 2), ("c", "2024", 3), ("d", "2025", 4), ("e", None, 5), ("f", "2026/S1 %", 6)]


@pytest.fixture
def table(spark, tmp_path, request):
    name = f"swap_{abs(hash(request.node.name))}"
    load_serving_table(spark.createDataFrame(ROWS, SCHEMA), name, path=str(tmp_path / "t"))
    yield name
    spark.sql(f"drop table {name}")


def rows_of(spark, table):
    return sorted(map(tuple, spark.table(table).select("record_id", "annee", "plaintes").collect()), key=str)


def files_of(spark, table, annee):
    return set(spark.table(table).where(F.col("annee").eqNullSafe(annee)).inputFiles())


def test_only_partitions_that_differ_are_written(spark, table, tmp_path):
    kept = {a: files_of(spark, table, a) for a in ("2023", None)}
    fresh = [*ROWS[:2], ("c", "2024", 30), ROWS[4], ("g", "2027", 7)]
    frame = spark.createDataFrame(fresh, SCHEMA)
    assert load_serving_table(frame, table, force=True, path=str(tmp_path / "t")) == 5
    assert rows_of(spark, table) == sorted(fresh, key=str)
    assert {a: files_of(spark, table, a) for a in ("2023", None)} == kept


def test_the_swap_names_what_it_wrote_and_removed(spark, table):
    fresh = [("b", "2023", 2), ("a", "2023", 1), ("c", "2024", 3), ("d", "2025", 5)]
    done = swap_partitions(spark.createDataFrame(fresh, SCHEMA), table, "annee")
    assert done["written"] == ["2025"] and set(done["removed"]) == {None, "2026/S1 %"}
    again = swap_partitions(spark.createDataFrame(fresh, SCHEMA), table, "annee")
    assert again == {"written": [], "removed": []}
    assert rows_of(spark, table) == sorted(fresh, key=str)


def test_the_null_partition_and_repeated_rows_are_swapped_like_any_other(spark, table):
    fresh = [*ROWS, ROWS[4], ROWS[0]]
    done = swap_partitions(spark.createDataFrame(fresh, SCHEMA), table, "annee")
    assert set(done["written"]) == {None, "2023"} and done["removed"] == []
    assert rows_of(spark, table) == sorted(fresh, key=str)


def test_a_load_that_fails_on_the_way_leaves_every_row(spark, table, tmp_path):
    frame = spark.createDataFrame([("a", "2023", 9), ("z", "2024", 9)], SCHEMA)
    broken = frame.withColumn("plaintes", F.when(F.col("annee") == "2024", F.raise_error(F.lit("cut"))).otherwise(F.col("plaintes")).cast("long"))
    with pytest.raises(Exception, match="cut"):
        load_serving_table(broken, table, force=True, path=str(tmp_path / "t"))
    assert rows_of(spark, table) == sorted(ROWS, key=str)


def test_an_unforced_load_and_an_empty_one(spark, table, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert load_serving_table(empty, table, path=str(tmp_path / "t")) == len(ROWS)
    assert load_serving_table(empty, table, force=True, path=str(tmp_path / "t")) == 0


def test_another_place_or_column_makes_the_table_anew(spark, table, tmp_path):
    frame = spark.createDataFrame(ROWS[:2], SCHEMA)
    assert load_serving_table(frame, table, force=True, path=str(tmp_path / "u")) == 2
    assert str(tmp_path / "u") in spark.table(table).inputFiles()[0]
    wider = frame.withColumn("note", F.lit("x"))
    assert load_serving_table(wider, table, force=True, path=str(tmp_path / "u")) == 2
    assert "note" in spark.table(table).columns
