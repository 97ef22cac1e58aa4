import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import anomaly_rules as rules, profile, quantiles, ranks
from tallyforge.operators.quantiles import exact_quantiles, order_statistics


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def random_columns():
    rng = np.random.default_rng(1)
    n = 4001
    return {
        "heavy": np.exp(rng.normal(0, 6, n)),
        "hot": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
        "whole": rng.poisson(3, n),
        "wide": rng.integers(-(2**60), 2**60, n),
    }


@pytest.mark.parametrize("small_range", [0, quantiles.SMALL_RANGE])
def test_quantiles_match_numpy(spark, monkeypatch, small_range):
    monkeypatch.setattr(quantiles, "SMALL_RANGE", small_range)
    data = random_columns()
    probabilities = [0.0, 0.25, 0.5, 0.8, 0.99, 1.0]
    found = exact_quantiles(frame(spark, **data), list(data), probabilities)
    for name, values in data.items():
        assert found[name] == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_order_statistics_keep_all_digits(spark):
    values = random_columns()["wide"]
    found = order_statistics(frame(spark, wide=values), {"wide": [0, 17, 4000]})["wide"]
    ordered = sorted(int(v) for v in values)
    assert found == {0: ordered[0], 17: ordered[17], 4000: ordered[4000]}


def test_quantiles_skip_missing_values(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert exact_quantiles(rows, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


@pytest.mark.parametrize("array_range,broadcast", [(4096, 100_000), (0, 100_000), (0, 50)])
def test_spearman_matches_pandas(spark, monkeypatch, array_range, broadcast):
    monkeypatch.setattr(ranks, "ARRAY_RANGE", array_range)
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(ranks, "HOT_VALUES", 20)
    data = pd.DataFrame(random_columns()).drop(columns="wide")
    found = ranks.spearman(frame(spark, **data), list(data.columns)).toPandas()
    matrix = found.pivot(index="i", columns="j", values="rho").to_numpy()
    assert matrix == pytest.approx(data.corr("spearman").to_numpy(), abs=1e-12)
    pairs = ranks.strongest_pairs(ranks.spearman(frame(spark, **data), list(data.columns)), 2).collect()
    assert len(pairs) == 2 and pairs[0].abs_rho >= pairs[1].abs_rho


@pytest.mark.parametrize("log", [False, True])
def test_histogram_matches_numpy(spark, log):
    values = np.random.default_rng(2).poisson(4, 3000)
    found = profile.histogram(frame(spark, x=values), ["x"], log=log).orderBy("bin").collect()
    expected = np.histogram(np.log1p(values) if log else values, bins=25)[0]
    assert [r.nombre for r in found] == list(expected)


def test_histogram_of_a_constant(spark):
    found = profile.histogram(frame(spark, x=[7, 7, 7]), ["x"]).where("nombre > 0").collect()
    assert [(r.bin, r.nombre) for r in found] == [(12, 3)]


def test_describe_matches_pandas(spark):
    data = pd.DataFrame({"x": random_columns()["whole"], "k": 5})
    found = {r.variable: r for r in profile.describe(frame(spark, **data), ["x", "k"]).collect()}
    assert found["x"].asymetrie_skewness == pytest.approx(round(data.x.skew(), 2))
    assert found["x"].std == pytest.approx(round(data.x.std(), 2))
    assert found["x"].pourcentage_zero == pytest.approx(round(100 * (data.x == 0).mean(), 2))
    assert found["k"].asymetrie_skewness == 0.0


def test_iqr_outliers(spark):
    row = profile.iqr_outliers(frame(spark, x=[1, 2, 3, 4, 100]), ["x"]).first()
    assert (row.borne_basse, row.borne_haute, row.nb_atypiques, row.pourcentage) == (-1.0, 7.0, 1, 20.0)


@pytest.mark.parametrize(
    "values,expected",
    [
        ([1, 2, 3, 4, 100], [-1.349, -0.6745, 0.0, 0.6745, 65.4265]),
        ([0, 0, 0, 0, 10], [-0.5, -0.5, -0.5, -0.5, 2.0]),
        ([3, 3, 3], [0.0, 0.0, 0.0]),
    ],
)
def test_robust_z(spark, values, expected):
    found = rules.robust_z(frame(spark, i=range(len(values)), x=values), "x").orderBy("i").collect()
    assert [r.robust_z for r in found] == pytest.approx(expected)


def test_severity_without_flags(spark):
    rows = spark.createDataFrame([(0.1, False, False)], "Score_anomalie double, Est_anomalie boolean, Infraction_non_renseignee boolean")
    assert rules.severity_cuts(rows) == (0.0, 0.0)
    assert rules.with_severity(rows, (0.0, 0.0)).first().Niveau_anomalie == "Normale"


def test_severity_levels(spark):
    scores = [float(s) for s in range(1, 11)]
    rows = spark.createDataFrame(
        [(s, True, s == 1.0) for s in scores],
        "Score_anomalie double, Est_anomalie boolean, Infraction_non_renseignee boolean",
    )
    levels = rules.with_severity(rows, rules.severity_cuts(rows)).orderBy(F.col("Score_anomalie"))
    assert [r.Niveau_anomalie for r in levels.collect()] == (
        ["Élevée"] + ["Faible"] * 4 + ["Moyenne"] * 3 + ["Élevée"] * 2
    )


def test_quantiles_with_infinite_values_and_wide_ranges(spark):
    inf = float("inf")
    data = {
        "ends": [-inf, 1.0, 2.0, 3.0, inf],
        "range": [-1.5e308, -1.0, 0.0, 1.0, 1.5e308],
        "tiny": [0.0, 5e-324, 1e-323, 1e-323, 5e-324],
        "longs": [-(2**63), -5, 0, 2**62, 2**63 - 1],
    }
    ranks_of = {name: list(range(5)) for name in data}
    found = order_statistics(frame(spark, **data), ranks_of)
    for name, values in data.items():
        assert [found[name][i] for i in range(5)] == sorted(values)
    quartiles = exact_quantiles(frame(spark, **data), ["ends"], [0.0, 0.25, 0.5, 1.0])["ends"]
    assert quartiles == [-inf, 1.0, 2.0, inf]
    assert exact_quantiles(frame(spark, a=[inf, inf, inf]), ["a"], [0.3]) == {"a": [inf]}


def test_reports_of_columns_without_values(spark):
    rows = spark.createDataFrame([], "a double, b long")
    assert profile.histogram(rows, ["a", "b"]).collect() == []
    assert profile.iqr_outliers(rows, ["a", "b"]).collect() == []


def test_spearman_ranks_each_pair_over_its_own_rows(spark):
    data = pd.DataFrame(random_columns()).drop(columns="wide").head(300).astype(float)
    rng = np.random.default_rng(5)
    data["gaps"] = data["heavy"].where(rng.random(300) < 0.6)
    data["more"] = (data["hot"] + data["whole"]).where(rng.random(300) < 0.4)
    data["none"] = np.nan
    found = ranks.spearman(frame(spark, **data), list(data.columns)).toPandas()
    matrix = found.pivot(index="i", columns="j", values="rho").to_numpy()
    assert matrix == pytest.approx(data.corr("spearman").to_numpy(), abs=1e-12, nan_ok=True)


def test_hot_equal_rows_spread(spark, monkeypatch):
    """Rows that are equal throughout land on many salts and in no single partition."""
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", 50)
    monkeypatch.setattr(ranks, "ARRAY_RANGE", 0)
    values = np.append(np.zeros(20_000), np.arange(200) + 0.5)
    rows = ranks.materialize(
        frame(spark, a=values).withColumn(ranks.ROW, F.monotonically_increasing_id()), "rows"
    )
    ranked = spark.createDataFrame([(0.0, 10_000.5, 20_000)], "a double, rank_a double, n long")
    spread = 1 + F.pmod(F.xxhash64(ranks.ROW), F.lit(ranks.SALTS))
    sizes = [r["count"] for r in rows.where("a = 0").repartition(8, "a", spread).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 20_000 / 8
    joined = ranks._join_many_values(rows, ranked, "a", len(values))
    assert joined.where("rank_a = 10000.5").count() == 20_000 and joined.count() == len(values)
