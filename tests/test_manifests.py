import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import stages
from tallyforge.sources import manifests
from tallyforge.sources.manifests import StageBroken, StageStale, read_version, write_version
from tallyforge.sources.tables import StageMissing


def test_a_version_is_read_back_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(StageMissing):
        read_version(spark, path, "absent")
    first = write_version(spark.range(5).toDF("x"), path)
    assert first.rows == 5 and read_version(spark, path, "").count() == 5
    held = read_version(spark, path, "")
    second = write_version(held.where("x > 1"), path)  # a stage may be made from itself
    assert sorted(r.x for r in read_version(spark, path, "").collect()) == [2, 3, 4]
    assert held.count() == 5 and second.fingerprint != first.fingerprint
    write_version(spark.range(1).toDF("x"), path)
    assert sorted(os.listdir(path)) == sorted(["_manifests", second.version, manifests.latest(spark, path).version])


def test_fingerprints_depend_on_rows_not_on_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(50)] + [(1, "b")] * 2, "x int, y string")
    prints = [
        write_version(df, str(tmp_path / name)).fingerprint
        for name, df in {"a": rows, "b": rows.orderBy(F.desc("x")).repartition(3), "c": rows.distinct(), "e": rows.limit(0)}.items()
    ]
    assert prints[0] == prints[1] and len(set(prints)) == 3 and prints[3] == "0:0"


def test_a_killed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    fails = spark.range(20).repartition(4).select(F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        write_version(fails, path)
    with pytest.raises(StageMissing):
        read_version(spark, path, "absent")
    write_version(spark.range(3).toDF("x"), path)
    with pytest.raises(Exception, match="stop"):
        write_version(fails, path)
    assert read_version(spark, path, "").count() == 3


def test_lost_files_are_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    version = write_version(spark.range(40).toDF("x").repartition(4), path).version
    os.remove(glob.glob(f"{path}/{version}/part-*")[0])
    with pytest.raises(StageBroken):
        read_version(spark, path, "")


def test_a_changed_input_is_noticed(spark, tmp_path):
    space = stages.Workspace(spark, str(tmp_path))
    space.write("clean", spark.range(4).toDF("x"))
    space.write("clustered", space.read("clean", "cleaning"), "clean")
    assert space.read("clustered", "clustering", "clean").count() == 4
    space.write("clean", spark.range(4).toDF("x"))  # the same rows again
    assert space.read("clustered", "clustering", "clean").count() == 4
    space.write("clean", spark.range(5).toDF("x"))
    with pytest.raises(StageStale):
        space.read("clustered", "clustering", "clean")
    assert space.read("clustered", "clustering").count() == 4
