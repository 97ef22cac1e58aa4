from datetime import date

import pytest

from tallyforge.operators import boosting, forest, kmeans, regressors
from tallyforge.plans import registry, stages
from tallyforge.runtime import RollingState, materialize, scratch_root
from tallyforge.sources import cells
from tallyforge.sources.tables import StageMissing

SF_DIR = "/root/testdata/sf0.001"


def test_stages_refuse_to_run_out_of_order(spark, tmp_path):
    space = stages.Workspace(spark, str(tmp_path))
    for stage in (stages.prepare_clusters, stages.prepare_anomalies, stages.prepare_models):
        with pytest.raises(StageMissing):
            stage(space)
    with pytest.raises(StageMissing):
        stages.load(space, "never")


def test_all_stages(spark, tmp_path):
    space = stages.Workspace(spark, str(tmp_path))
    stages.prepare_all(
        space,
        cells.coarse_cells(spark, SF_DIR),
        cells.official_totals(spark, SF_DIR),
        cells.ORDINAL,
        cells.PERIOD_FACTORS,
        restarts=(1, 1),
        isolation_trees=20,
        models={regressors.RIDGE: regressors.fit_ridge},
        repeats=1,
    )
    rows = cells.coarse_cells(spark, SF_DIR).count()
    for name in ("clean", "clustered", "anomalies", "predictions", "enriched"):
        assert space.read(name, "any").count() == rows
    assert stages.load(space, "stage_load", force=True) == rows
    assert stages.load(space, "stage_load") == rows


def test_scratch_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    frame = materialize(spark.range(3).toDF("x"))
    assert f"{scratch_root(spark)}/tallyforge/" in frame.inputFiles()[0]


def test_rolling_state_keeps_two_copies(spark):
    state = RollingState(spark, "rolling")
    frame = state.save(spark.range(5).toDF("x"))
    for _ in range(4):
        frame = state.save(frame.selectExpr("x + 1 as x"))
    assert sorted(r.x for r in frame.collect()) == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("name", ["p11_clean_table", "j1_reconcile", "a2_row_counts", "o1_listing", "p17_share_of_total"])
def test_plans_have_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_listing_takes_the_top_rows_and_prunes_columns(spark):
    plan = registry.QUERIES["a4_statistics_by_period"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_custkey" not in plan
    assert "TakeOrderedAndProject" in registry.QUERIES["o1_listing"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_scratch_is_cleared_for_this_application_alone(spark):
    from tallyforge.runtime import clear_scratch, exists, materialize, scratch_root

    kept = f"{scratch_root(spark)}/tallyforge/another-application/x"
    spark.range(3).write.parquet(kept)
    stored = materialize(spark.range(5), "rows")
    path = stored.inputFiles()[0]
    assert exists(spark, path)
    clear_scratch(spark)
    assert not exists(spark, path) and exists(spark, kept)


def test_a_preparation_reads_the_facts_once(spark, tmp_path, monkeypatch):
    """Cells and official totals come from one reading, whatever keys repeat, are null or unknown."""
    lines = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double, l_shipdate date"
    orders = "o_orderkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"
    parts = [(0, "a", "x"), (0, "a", "x"), (1, "a", "y"), (1, "b", None), (2, "a", "x"), (None, "c", "z"), (3, None, "x")]
    made = {
        "lineitem": (
            [
                (i % 7, (0, 1, 2, 3, 9, None)[i % 6], (1.0, None, 5.0)[i % 3], "ARN"[i % 3], "FO"[i % 2], 0.01 * i, (None, 0.08)[i % 2], date(2000, 5, 1 + i % 28))
                for i in range(90)
            ],
            lines,
        ),
        "orders": ([(i % 6, "FOP"[i % 3], date(1997 + i, 1, 1) if i else None, ("1-URGENT", None)[i % 2]) for i in range(7)], orders),
        "part": (parts, "p_partkey long, p_type string, p_name string"),
    }
    for name, (rows, shape) in made.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    wanted = cells.coarse_cells(spark, str(tmp_path)), cells.official_totals(spark, str(tmp_path))
    read, given, facts = [], [], cells.fact_rows
    monkeypatch.setattr(cells, "fact_rows", lambda *own: read.append(1) or facts(*own))
    monkeypatch.setattr(stages, "prepare_all", lambda space, raw, official, *rest, **named: given.extend([raw, official]))
    registry._prepared(spark, str(tmp_path))
    assert len(read) == 1
    for own, plain in zip(given, wanted, strict=True):
        assert own.schema.names == plain.schema.names and own.dtypes == plain.dtypes
        assert plain.count() > 3 and sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))


def test_few_rows_take_few_tasks(spark):
    """A pass over some hundred rows is one task, not one for every core."""
    rows = spark.range(600).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as label", f"id as {forest.KEY}")
    assert len(kmeans.distinct_points(rows, ["a"]).inputFiles()) == 1
    binning = boosting.fit_binning(rows, {"a": "a"}, {}, 8)
    assert len(forest._state(rows, binning, boosting.Lanes([None])).inputFiles()) == 1
