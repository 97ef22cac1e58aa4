import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyforge.operators import kmeans

COLUMNS = ["x", "y"]


def blobs(seed=3, n=400):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [8, 0], [0, 9], [9, 9]])
    own = centres[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, 2))
    return np.round(own, 1)


@pytest.fixture(scope="module")
def points(spark):
    rows = [tuple(map(float, p)) for p in np.vstack([blobs(), blobs()[:150]])]
    frame = spark.createDataFrame(rows, "x double, y double").repartition(7)
    return np.array(rows), frame, kmeans.distinct_points(frame, COLUMNS)


def brute_lloyd(rows, centres):
    while True:
        label = ((rows[:, None] - centres) ** 2).sum(2).argmin(1)
        fresh = np.array([rows[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(centres)])
        if np.abs(fresh - centres).max() < 1e-9:
            return fresh, label
        centres = fresh


def test_points_are_weighted(points):
    rows, _, stored = points
    row = stored.agg(F.count("*"), F.sum(kmeans.WEIGHT)).first()
    assert tuple(row) == (len(np.unique(rows, axis=0)), len(rows))


def test_best_of_all_restarts(points):
    rows, frame, stored = points
    fits = kmeans.fit_all(stored, COLUMNS, [2, 3, 4, 5], restarts=12)
    for k, fit in fits.items():
        fresh, label = brute_lloyd(rows, fit.centres)
        assert np.abs(fresh - fit.centres).max() < 1e-6
        assert sorted(np.bincount(label, minlength=k)) == sorted(fit.sizes)
        assert fit.cost == pytest.approx(((rows - fresh[label]) ** 2).sum())
        # No start from rows drawn at random ends better.
        rng = np.random.default_rng(k)
        for _ in range(12):
            other, own = brute_lloyd(rows, rows[rng.choice(len(rows), k, replace=False)])
            assert fit.cost <= ((rows - other[own]) ** 2).sum() + 1e-6
    placed = fits[4].transformer(COLUMNS).transform(frame).groupBy(kmeans.RAW_LABEL).count().collect()
    assert sorted(r["count"] for r in placed) == sorted(fits[4].sizes)


def test_one_pass_is_a_lloyd_step_for_every_fit(points):
    rows, _, stored = points
    rng = np.random.default_rng(1)
    none = np.zeros(0)
    starts = [rows[rng.choice(len(rows), k, replace=False)] for k in (2, 3, 3, 5)]
    moved = kmeans._pass(stored, COLUMNS, [kmeans.Centres(s, none, none, np.inf) for s in starts])
    for start, fit in zip(starts, moved, strict=True):
        label = ((rows[:, None] - start) ** 2).sum(2).argmin(1)
        for i in range(len(start)):
            if (label == i).any():
                assert fit.centres[i] == pytest.approx(rows[label == i].mean(0))
        assert fit.cost == pytest.approx(((rows - start[label]) ** 2).sum())


def test_silhouettes_are_the_evaluators(points):
    _, frame, stored = points
    fits = kmeans.fit_all(stored, COLUMNS, [2, 4], restarts=3)
    found = kmeans.silhouettes(stored, COLUMNS, fits)
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(frame)
    for k, fit in fits.items():
        placed = fit.transformer(COLUMNS).transform(vectors).withColumn("p", F.col(kmeans.RAW_LABEL).cast("double"))
        evaluator = ClusteringEvaluator(featuresCol="v", predictionCol="p")
        assert found[k] == pytest.approx(evaluator.evaluate(placed), abs=1e-9)


def test_repeats_on_any_partitioning(spark, points):
    _, frame, stored = points
    other = kmeans.distinct_points(frame.repartition(2).orderBy("y"), COLUMNS)
    one, two = (kmeans.fit_all(p, COLUMNS, [3], restarts=4)[3] for p in (stored, other))
    assert np.allclose(one.centres, two.centres)


def test_few_or_no_points(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    fit = kmeans.fit_all(kmeans.distinct_points(same, COLUMNS), COLUMNS, [2], restarts=2)[2]
    assert sorted(fit.sizes) == [0, 5] and fit.cost == 0
    assert kmeans.fit_all(kmeans.distinct_points(same.limit(0), COLUMNS), COLUMNS, [2], restarts=2) == {}


def test_a_pass_adds_up_by_products(spark, monkeypatch):
    """No point is counted fit by fit; a tie goes to the first centre."""
    rng = np.random.default_rng(2)
    own = rng.integers(0, 4, (200, 2)).astype(float)
    centres = rng.integers(0, 4, (30, 3, 2)).astype(float)
    nearest, least = kmeans._nearest(own, centres.reshape(-1, 2), 30, 3)
    square = ((own[None, :, None] - centres[:, None]) ** 2).sum(3)
    assert (nearest == square.argmin(2)).all()
    assert least + (own * own).sum(1) == pytest.approx(square.min(2))
