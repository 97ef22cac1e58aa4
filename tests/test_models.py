import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.operators import anomaly_rules as rules, clustering, isolation, regressors, validation
from tallyforge.operators.scoring import score
from tallyforge.runtime import scratch_path
from tallyforge.sources.models import load_model, save_model
from tallyforge.sources.tables import StageMissing


def outlier_rows(spark):
    rows = []
    for i in range(30):
        row = {c: 1 + i % 3 for c in S.ANOMALY_FEATURES}
        rows.append(row | {S.RECORD_ID: f"INF-{i}", S.MISSING_LABEL: i == 0, "Volume_activite": 10})
    rows[-1]["Saisine_Plaintes_directes"] = 10000
    return spark.createDataFrame(pd.DataFrame(rows))


def test_planted_outlier_is_found(spark):
    flagged, metrics, forest = isolation.detect_anomalies(outlier_rows(spark), contamination=0.1, trees=100)
    rows = {r[S.RECORD_ID]: r for r in flagged.collect()}
    top = max(rows.values(), key=lambda r: r[rules.SCORE])
    assert top[S.RECORD_ID] == "INF-29" and top[rules.ML_FLAG] and top[rules.LEVEL] == S.LEVEL_HIGH
    assert rows["INF-29"][rules.REASONS] == "Saisine_Plaintes_directes" + S.REASON_HIGH
    assert rows["INF-0"][rules.REASONS] == S.REASON_LABEL and rows["INF-0"][rules.LEVEL] == S.LEVEL_HIGH
    document = metrics.first()
    assert document.nombre_observations == 30 and document.nombre_anomalies_regles == 2
    assert forest.feature.shape[0] == 100


def test_forest_is_repeatable_and_contamination_sets_the_share(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({c: rng.normal(size=1500) for c in ("a", "b")})
    data["id"] = [f"r{i}" for i in range(1500)]
    rows = spark.createDataFrame(data)
    forests = [isolation.fit_forest(r, ["a", "b"], "id", trees=40) for r in (rows, rows.repartition(5))]
    assert np.array_equal(forests[0].threshold, forests[1].threshold)
    scored = rows.select("a", "b", isolation.isolation_score(spark, forests[0]).alias(isolation.ISOLATION)).cache()
    table = scored.toPandas()
    far = np.hypot(table.a, table.b)
    assert np.corrcoef(far, table[isolation.ISOLATION])[0, 1] > 0.7
    for row in isolation.contamination_sweep(scored).collect():
        assert row.nombre_anomalies_ml == math.ceil(row.contamination * 1499)


@pytest.mark.parametrize("rows", [100, 20_000, 300_000])
def test_every_row_can_reach_a_tree(spark, rows):
    """One draw at any size: about two samples a tree, from all parts of the table."""
    table = spark.range(rows).selectExpr("cast(id as string) as id", "cast(id as double) as a")
    drawn = isolation._draw_samples(table, ["a"], "id", rows, 10, 64, 42)
    found = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.max("a").alias("top")).collect()
    assert len(found) == 10 and min(r.n for r in found) >= 64 and max(r.n for r in found) <= 200
    if rows > 1000:
        assert len({r.top for r in found}) > 5 and min(r.top for r in found) > 0.8 * rows


def shape_rows(spark):
    rows = []
    for i in range(40):
        rows.append({c: ((i % 5) + 1) * (8 if i >= 30 else 1) for c in S.CLUSTER_FEATURES})
    return spark.createDataFrame(pd.DataFrame(rows))


def test_cluster_table(spark):
    out, metrics, model = clustering.cluster_table(shape_rows(spark), sweep_restarts=1, final_restarts=2)
    assert out.columns == [*S.CLUSTER_FEATURES, "Cluster", "PCA_1", "PCA_2"]
    row = metrics.first()
    assert row.transformation == "log1p + StandardScaler"
    assert row.variance_pca_expliquee[0] == pytest.approx(1.0)
    assert sum(row.taille_clusters.values()) == 40 and list(row.taille_clusters) == sorted(row.taille_clusters)
    for listed in (row.diagnostic_brut, row.diagnostic_log1p):
        assert [r.k for r in listed] == sorted(r.k for r in listed)
        assert all(sum(r.tailles_clusters.values()) == 40 for r in listed)
    sizes = [r["count"] for r in out.groupBy("Cluster").count().orderBy("Cluster").collect()]
    assert sum(sizes) == 40 and sizes == sorted(sizes, reverse=True)
    path = scratch_path(spark, "clusters")
    save_model(model, path)
    again = clustering.apply_clusters(load_model(path), shape_rows(spark))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def brute_silhouette(points, labels):
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    widths = []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(labels)) != i)
        if not mates.any():
            widths.append(0.0)
            continue
        inner = distance[i, mates].mean()
        outer = min(distance[i, labels == other].mean() for other in set(labels) - {own})
        widths.append((outer - inner) / max(inner, outer))
    return float(np.mean(widths))


def test_euclidean_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, size=(300, 2)).astype(float)
    labels = np.append((points[:-1].sum(axis=1) > 5).astype(int), 2)
    rows = spark.createDataFrame(pd.DataFrame({"x": points[:, 0], "y": points[:, 1], "label": labels}))
    found = clustering.euclidean_silhouette(rows, ["x", "y"], "label")
    assert found == pytest.approx(brute_silhouette(points, labels))
    in_blocks = clustering.euclidean_silhouette(rows, ["x", "y"], "label", block_points=9)
    assert in_blocks == pytest.approx(found)


def test_a_tile_takes_each_distance_once_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(8)
    points = np.vstack([rng.integers(0, 5, size=(700, 2)), rng.integers(0, 5, size=(1200, 2))]) + 1e7
    block = np.repeat([0, 1], [700, 1200])
    rows = pd.DataFrame({"a": points[:, 0], "b": points[:, 1], "own": np.arange(1900) % 2, "n": 1 + np.arange(1900) % 3})
    rows = rows.assign(block=block, point=np.arange(1900), low=0, high=1)
    taken, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda x, **named: taken.append(x.size) or root(x, **named))
    run = clustering._distance_sums(["a", "b"], ["s0", "s1"])
    both = run(rows).set_index("point").sort_index()
    assert sum(taken) == 700 * 1200
    alone = run(rows[block == 0].assign(high=0)).set_index("point").sort_index()
    far = root(((points[:, None] - points[None]) ** 2).sum(2))
    weight = np.zeros((1900, 2))
    weight[np.arange(1900), rows.own] = rows.n
    other = np.where((block[:, None] != block[None])[:, :, None], weight[None], 0.0)
    assert both[["s0", "s1"]].to_numpy() == pytest.approx(np.einsum("ij,ijk->ik", far, other))
    assert alone[["s0", "s1"]].to_numpy() == pytest.approx(far[:700, :700] @ weight[:700])
    same = run(rows.assign(a=2.0, b=3.0))[["s0", "s1"]].to_numpy()
    assert not same.any()


def test_metric_does_not_depend_on_the_size(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_POINTS", 10)
    vectors, _ = clustering.scaled_vectors(shape_rows(spark), S.CLUSTER_FEATURES, log=True)
    few = clustering.evaluate_k(vectors.limit(12), S.CLUSTER_FEATURES, restarts=1)
    many = clustering.evaluate_k(vectors, S.CLUSTER_FEATURES, restarts=1)
    assert {r.metrique_silhouette for r in few.collect() + many.collect()} == {"squared"}
    with pytest.raises(ValueError):
        clustering.evaluate_k(vectors, S.CLUSTER_FEATURES, metric="auto")


def test_choice_of_k(spark):
    fields = "k int, silhouette double, ratio_cluster_min double"
    rows = spark.createDataFrame([(2, 0.9, 0.01), (3, 0.6, 0.2), (4, 0.6, 0.3)], fields)
    assert clustering.choose_k(rows) == 3
    assert clustering.choose_k(rows.where("k = 2")) == 2
    with pytest.raises(ValueError):
        clustering.choose_k(rows.limit(0))


def model_frame():
    rows = []
    for i in range(45):
        row = {S.RECORD_ID: f"R-{i}", S.PERIOD: ["2024", "2025", "2026-S1"][i % 3], S.CATEGORY: f"C{i % 4}", S.LABEL: f"I{i}"}
        row |= {c: (i + j) % 12 for j, c in enumerate(S.NUMERIC_FEATURES)}
        row[S.TARGET] = max(0, int(0.8 * row["MiseEnCause_Interpelles"] + i % 3))
        rows.append(row)
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def model_rows(spark):
    return spark.createDataFrame(model_frame()).cache()


def test_folds(spark, model_rows):
    folded = validation.shuffled_folds(model_rows)
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert sizes == [9] * 5
    uneven = validation.shuffled_folds(model_rows.limit(43)).groupBy("fold").count().orderBy("fold")
    assert [r["count"] for r in uneven.collect()] == [9, 9, 9, 8, 8]
    periods, count = validation.period_folds(model_rows)
    assert count == 3
    assert {(r.Annee, r.fold) for r in periods.collect()} == {("2024", 0), ("2025", 1), ("2026-S1", 2)}


def test_ridge_matches_the_closed_form(spark, model_rows):
    data = model_frame()
    numeric = data[S.NUMERIC_FEATURES].astype(float)
    scaled = ((numeric - numeric.mean()) / numeric.std(ddof=0)).to_numpy()
    x = np.hstack([scaled, pd.get_dummies(data[S.PERIOD]), pd.get_dummies(data[S.CATEGORY])]).astype(float)
    y = data[S.TARGET].to_numpy(float)
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 10 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    expected = dict(zip(data[S.RECORD_ID], centred @ weights + y.mean()))
    found = regressors.fit_ridge(model_rows).transform(model_rows).collect()
    assert [r.prediction for r in found] == pytest.approx([expected[r[S.RECORD_ID]] for r in found], abs=1e-8)


def test_imputation_and_unseen_categories(spark, model_rows):
    gaps = model_rows.withColumn("Saisine_FD", F.expr("if(Saisine_FD > 8, null, Saisine_FD)")).withColumn(
        S.CATEGORY, F.expr(f"nullif({S.CATEGORY}, 'C3')")
    )
    fill = regressors.fit_imputation(gaps, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
    assert set(fill.medians) == {"Saisine_FD"} and fill.modes == {S.CATEGORY: "C0"}
    model = regressors.fit_ridge(gaps)
    unseen = gaps.limit(1).withColumn(S.CATEGORY, F.lit("C9")).withColumn(S.PERIOD, F.lit("2030"))
    row = model.transform(unseen).first()
    assert row._h_Categorie.numNonzeros() == 0 and row._h_Annee.numNonzeros() == 0
    assert math.isfinite(row.prediction)


def test_comparison_reports_both_validations(spark, model_rows):
    models = regressors.candidate_models(trees=5, rounds=1)
    found = validation.evaluate_models(model_rows, models)
    rows = found.results.collect()
    assert {r.modele for r in rows} == set(models) and all(r.validation_par_periode.mae >= 0 for r in rows)
    scores = {r.modele: r.validation_kfold.rmse for r in rows}
    assert found.best_name == min(scores, key=scores.get)
    assert scores[found.best_name] < scores[regressors.MEDIAN]
    assert found.predictions.count() == 45 and "Residu" in found.predictions.columns
    importances = validation.permutation_importance(model_rows, found.best_model, repeats=2)
    assert importances.count() == len(S.MODEL_FEATURES)
    document = validation.regression_metrics(found, importances, 45).first()
    errors = [r.validation_kfold.rmse for r in document.resultats]
    assert errors == sorted(errors) and document.nombre_observations == 45


def test_importance_separates_signal_from_noise(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({c: rng.poisson(5, 600) for c in S.NUMERIC_FEATURES})
    data[S.PERIOD], data[S.CATEGORY] = "2024", "C"
    data[S.TARGET] = 3 * data["Victimes_H"]
    rows = spark.createDataFrame(data)
    found = {r.variable: r.importance for r in validation.permutation_importance(rows, regressors.fit_ridge(rows), repeats=3).collect()}
    assert max(found, key=found.get) == "Victimes_H" and found["Victimes_H"] > 3
    assert all(abs(v) < 0.2 for name, v in found.items() if name != "Victimes_H")


def test_boosting_approaches_the_target_and_survives_saving(spark, model_rows):
    model = regressors.fit_boosting(model_rows, rounds=12, rate=0.5, save_every=5)
    path = scratch_path(spark, "boosting")
    save_model(model, path)
    fitted, reloaded = (
        m.transform(model_rows).orderBy(S.RECORD_ID).collect() for m in (model, load_model(path))
    )
    assert [r.prediction for r in fitted] == [r.prediction for r in reloaded]
    error = np.mean([abs(r[S.TARGET] - r.prediction) for r in fitted])
    assert error < 1.0
    with pytest.raises(StageMissing):
        load_model(path + "-none")


def test_scoring(spark, model_rows):
    given = spark.createDataFrame([(1, "C0", 4), (2, "C9", -2)], "n int, categorie string, interpelles long")
    scored, rejected = score(given, regressors.fit_ridge(model_rows), regressors.RIDGE)
    row = scored.first()
    assert (row.n, row.annee, row.modele) == (1, "2026-S1", "Ridge") and row.resultats_def_estimes >= 0
    assert rejected.count() == 1


def test_equal_rows_do_not_share_a_place(spark):
    """Importance orders rows by their id's hash, so equal rows do not meet in one task."""
    rows = spark.range(40_400).selectExpr("cast(id as string) as id", "if(id < 40000, 0, id) as a")
    placed = rows.select(F.expr("xxhash64(id, 42) as _order")).repartitionByRange(8, "_order")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 40_400 / 8
