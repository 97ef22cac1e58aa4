"""Queries that state what must hold of fitted models, as (controle, valeur) rows.

Fits depend on random draws that SQL cannot repeat. Each query here runs the same operator
over the same rows as its namesake and reduces the outcome to figures that are exact
whatever the draw: row counts, shares, optimality conditions and orders.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge import schema as S
from tallyforge.operators import anomaly_rules as rules
from tallyforge.operators import clustering, isolation, regressors, validation
from tallyforge.operators.regressors import PREDICTION
from tallyforge.operators.scoring import score
from tallyforge.plans import registry
from tallyforge.plans.oracle import FINE_CLEAN, COARSE_CLEAN
from tallyforge.runtime import materialize

QUERIES = {}
EXPECTED: dict[str, tuple[str, dict[str, str]]] = {}


def check(source: str = FINE_CLEAN, **expected: str):
    """Register a query and, in SQL over ``clean`` and its size ``n``, what it must return."""

    def register(function):
        QUERIES[function.__name__] = function
        EXPECTED[function.__name__] = (source, expected)
        return function

    return register


def oracle() -> dict[str, str]:
    out = {}
    for name, (source, expected) in EXPECTED.items():
        rows = " union all ".join(
            f"select '{key}' as controle, ({value})::double as valeur from size" for key, value in expected.items()
        )
        out[name] = f"with {source}, size as (select count(*) as n from clean) {rows}"
    return out


def _figures(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "controle string, valeur double")


@check(lignes="n", anomalies_ml="ceil(0.08 * (n - 1))", drapeaux_incoherents="0", niveaux_incoherents="0", scores_hors_bornes="0")
def r6_isolation_checks(spark, sf_dir):
    flagged, _, _ = registry._detected(spark, sf_dir)
    either = F.col(rules.ML_FLAG) | F.col(rules.RULE_FLAG)
    row = flagged.agg(
        F.count("*").alias("lignes"),
        F.count_if(rules.ML_FLAG).alias("anomalies_ml"),
        F.count_if(F.col(rules.FLAG) != either).alias("drapeaux_incoherents"),
        F.count_if((F.col(rules.LEVEL) == S.LEVEL_NORMAL) == F.col(rules.FLAG)).alias("niveaux_incoherents"),
        F.count_if(~F.col(rules.SCORE).between(-1, 1)).alias("scores_hors_bornes"),
    ).first()
    return _figures(spark, **row.asDict())


@check(
    observations="n", anomalies_ml="ceil(0.08 * (n - 1))", variables="11", seuils="11", contaminations="5",
    flagues="ceil(0.03 * (n - 1)) + ceil(0.05 * (n - 1)) + ceil(0.08 * (n - 1)) + ceil(0.1 * (n - 1)) + ceil(0.15 * (n - 1))",
    severites="0",
)
def r10_anomaly_checks(spark, sf_dir):
    _, metrics, _ = registry._detected(spark, sf_dir)
    row = metrics.first()
    steps = row.sensibilite_contamination
    return _figures(
        spark, observations=row.nombre_observations, anomalies_ml=row.nombre_anomalies_ml,
        variables=len(row.variables), seuils=len(row.seuils_regles), contaminations=len(steps),
        flagues=sum(s.nombre_anomalies_ml for s in steps),
        severites=row.nombre_anomalies_finales - sum(row.repartition_severite.values()),
    )


@check(lignes="n", groupes="3", mal_affectes="0", etiquettes_ordonnees="1", centres_decales="0")
def c2_kmeans_checks(spark, sf_dir):
    """No row is nearer to another centre, and no centre is far from its rows' mean."""
    points = materialize(registry._scaled(registry.stored_fine(spark, sf_dir, *S.CLUSTER_FEATURES)), "points")
    model = clustering.fit_kmeans(points, k=3, restarts=40)
    labels = clustering.relabel_sql(clustering.canonical_labels(model))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    vector = vector_to_array(clustering.VECTOR)

    def distance(centre):
        pairs = F.zip_with(vector, F.array(*map(F.lit, centre)), lambda x, y: (x - y) * (x - y))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    placed = model.transformer(clustering.scaled_names(S.CLUSTER_FEATURES)).transform(points).select(
        clustering.RAW_LABEL, F.expr(labels).alias("label"), vector.alias("v"),
        F.array(*map(distance, centres)).alias("d"),
    )
    row = placed.agg(
        F.count("*").alias("lignes"), F.countDistinct("label").alias("groupes"),
        F.count_if(F.element_at("d", F.col(clustering.RAW_LABEL) + 1) > F.array_min("d") + 1e-9).alias("mal_affectes"),
    ).first()
    sizes = [r[0] for r in placed.groupBy("label").count().orderBy("label").select("count").collect()]
    means = placed.groupBy(clustering.RAW_LABEL).agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(centres[0]))])
    moved = sum(
        max(abs(r[i + 1] - x) for i, x in enumerate(centres[r[0]])) > 1e-6 for r in means.collect()
    )
    ordered = sizes == sorted(sizes, reverse=True)
    return _figures(spark, **row.asDict(), etiquettes_ordonnees=ordered, centres_decales=moved)


def _sweep_figures(rows: list, size: int) -> dict:
    return {
        "ks": sum(r.k for r in rows),
        "lignes": sum(sum(r.tailles_clusters.values()) for r in rows),
        "parts_fausses": sum(abs(r.ratio_cluster_min - r.taille_min_cluster / size) > 1e-9 for r in rows),
        "silhouettes_hors_bornes": sum(not -1 <= r.silhouette <= 1 for r in rows),
        "groupes_faux": sum(len(r.tailles_clusters) != r.k for r in rows),
    }


SWEEP = {"ks": "20", "lignes": "5 * n", "parts_fausses": "0", "silhouettes_hors_bornes": "0", "groupes_faux": "0"}


@check(**SWEEP)
def c4_k_sweep_checks(spark, sf_dir):
    vectors = materialize(registry._cluster_vectors(spark, sf_dir, log=True), "vectors")
    found = clustering.evaluate_k(vectors, S.CLUSTER_FEATURES).collect()
    return _figures(spark, **_sweep_figures(found, vectors.count()))


@check(
    lignes="n", moyenne_1="0", moyenne_2="0", covariance="0", axes_ordonnes="1", parts_dans_l_ordre="1",
    variance_expliquee="0",
)
def c6_pca_checks(spark, sf_dir):
    """Axes are centred, uncorrelated, in order, and carry the stated shares of variance."""
    points = materialize(registry._scaled(registry.stored_fine(spark, sf_dir, *S.CLUSTER_FEATURES)), "points")
    (one, two), shares = clustering.fit_axes(points, S.CLUSTER_FEATURES)
    row = points.selectExpr(f"{one} as a", f"{two} as b").agg(
        F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.covar_pop("a", "b").alias("ab"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"),
    ).first()
    total = points.agg(sum(F.var_pop(z) for z in clustering.scaled_names(S.CLUSTER_FEATURES))).first()[0]
    gap = max(abs(row.va / total - shares[0]), abs(row.vb / total - shares[1]))
    return _figures(
        spark, lignes=row.n, moyenne_1=_rounded(row.ma), moyenne_2=_rounded(row.mb), covariance=_rounded(row.ab),
        axes_ordonnes=row.va >= row.vb, parts_dans_l_ordre=1 >= shares[0] >= shares[1] >= 0, variance_expliquee=_rounded(gap),
    )


def _rounded(value: float, digits: int = 6) -> float:
    return abs(round(value, digits))


@check(**{f"{name}_{key}": value for name in ("brut", "log1p") for key, value in SWEEP.items()})
def c7_transformation_checks(spark, sf_dir):
    rows, size = {}, 0
    for name in ("brut", "log1p"):
        vectors = materialize(registry._cluster_vectors(spark, sf_dir, name == "log1p"), "vectors")
        rows[name], size = clustering.evaluate_k(vectors, S.CLUSTER_FEATURES), vectors.count()
    both = clustering.compare_transformations(rows["brut"], rows["log1p"]).collect()
    values = {}
    for name in rows:
        found = _sweep_figures([r for r in both if r.transformation == name], size)
        values |= {f"{name}_{key}": value for key, value in found.items()}
    return _figures(spark, **values)


@check(lignes="n", diagnostics="10", profils="0", k_choisi="1", variance="1", silhouette="0")
def c8_metric_checks(spark, sf_dir):
    stored = registry.stored_fine(spark, sf_dir)
    _, metrics, _ = clustering.cluster_table(stored)
    row = metrics.first()
    best = {r.k: r.silhouette for r in row.diagnostic_log1p}
    return _figures(
        spark, lignes=sum(row.taille_clusters.values()), diagnostics=len(row.diagnostic_brut) + len(row.diagnostic_log1p),
        profils=len(row.profils) - row.meilleur_k, k_choisi=row.meilleur_k in best,
        variance=0 < sum(row.variance_pca_expliquee) <= 1 + 1e-9, silhouette=_rounded(best[row.meilleur_k] - row.score_silhouette),
    )


@check(lignes="n", moyenne='round((select avg("Resultats_DEF") from clean), 4)', gradient="0", residu_moyen="0")
def m6_ridge_checks(spark, sf_dir):
    """The normal equations of the penalised fit: their residuals are 0."""
    rows = registry.stored_model_rows(spark, sf_dir)
    model = regressors.fit_ridge(rows)
    linear = model.stages[-1]
    fitted = [s for s in model.stages if hasattr(s, "coefficients")]
    linear = fitted[-1] if fitted else linear
    vector = linear.getFeaturesCol()
    scored = model.transform(rows).withColumns(
        {"_x": vector_to_array(vector), "_r": F.col(S.TARGET) - F.col(PREDICTION)}
    )
    weights = [float(w) for w in linear.coefficients]
    size = scored.count()
    sums = scored.agg(
        F.avg(PREDICTION).alias("mean"), F.avg("_r").alias("rest"),
        *[F.sum(F.col("_x")[i] * F.col("_r")).alias(f"g{i}") for i in range(len(weights))],
    ).first()
    worst = max(abs(sums[f"g{i}"] - 10.0 * w) / size for i, w in enumerate(weights))
    return _figures(spark, lignes=size, moyenne=round(sums["mean"], 4), gradient=_rounded(worst, 3), residu_moyen=_rounded(sums["rest"], 4))


def _beats_median(spark, rows: DataFrame, model) -> tuple:
    middle = regressors.fit_median(rows)

    def errors(fitted) -> tuple:
        error = F.col(S.TARGET) - F.col(PREDICTION)
        return fitted.transform(rows).agg(
            F.count(PREDICTION), F.sqrt(F.avg(error * error)), F.avg(F.abs(error)), F.min(PREDICTION), F.max(PREDICTION)
        ).first()

    own, base = errors(model), errors(middle)
    low, high = rows.agg(F.min(S.TARGET), F.max(S.TARGET)).first()
    return own, base, low, high


@check(lignes="n", erreur_reduite="1", dans_l_etendue="1")
def m7_forest_checks(spark, sf_dir):
    rows = registry.stored_model_rows(spark, sf_dir)
    own, base, low, high = _beats_median(spark, rows, regressors.fit_forest_regressor(rows, trees=20))
    return _figures(spark, lignes=own[0], erreur_reduite=own[1] < base[1], dans_l_etendue=low - 1e-9 <= own[3] <= own[4] <= high + 1e-9)


@check(lignes="n", erreur_reduite="1", rondes="20", pertes_en_hausse="0", feuilles="160")
def m8_boosting_checks(spark, sf_dir):
    """The first 20 of the model's rounds: the training loss falls in each, nothing is left out."""
    rows = registry.stored_model_rows(spark, sf_dir)
    (model,), (fit,) = regressors.fit_boosting_lanes(rows, [None], rounds=20)
    own, base, _, _ = _beats_median(spark, rows, model)
    rises = sum(b > a for a, b in zip(fit.losses, fit.losses[1:]))
    return _figures(
        spark, lignes=own[0], erreur_reduite=own[2] < base[2], rondes=len(fit.trees), pertes_en_hausse=rises,
        feuilles=sum(len(t.value) for t in fit.trees),
    )


@check(modeles="4", ordre="1", meilleur_en_tete="1", scores_nuls="0", scores_recalcules="1", lignes_predites="n")
def m13_comparison_checks(spark, sf_dir):
    """The best model's stated MAE and RMSE are those of its own held-out predictions."""
    stored, found = registry._comparison(spark, sf_dir)
    rows = found.results.select("modele", F.col("validation_kfold.rmse").alias("rmse")).collect()
    board = [r.modele for r in validation.leaderboard(registry.flatten_results(found.results), "kfold_rmse").collect()]
    by = {r.modele: r.rmse for r in rows}
    ranked = [by[m] for m in board]
    best = found.results.where(F.col("modele") == found.best_name).first().validation_kfold
    folds = validation.shuffled_folds(stored.select(S.RECORD_ID)).select(S.RECORD_ID, validation.FOLD)
    # The table's values are rounded to cents and cut off at 0, so errors can only be near.
    error = F.col(validation.ACTUAL) - F.col(validation.PREDICTED)
    again = found.predictions.join(folds, S.RECORD_ID).groupBy(validation.FOLD).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.count("*").alias("n")
    ).agg(F.avg("mae"), F.sqrt(F.avg("mse")), F.sum("n")).first()
    near = again[0] <= best.mae + 0.01 and again[1] <= best.rmse + 0.01 and abs(again[1] - best.rmse) < 0.05 * best.rmse
    return _figures(
        spark, modeles=len(rows), ordre=ranked == sorted(ranked), meilleur_en_tete=board[0] == found.best_name,
        scores_nuls=sum(not math.isfinite(v) or v <= 0 for v in ranked), scores_recalcules=near, lignes_predites=again[2],
    )


@check(lignes="n", distinctes="n", sans_prediction="0", meilleur_que_la_mediane="1")
def m14_out_of_fold_checks(spark, sf_dir):
    folded = materialize(validation.shuffled_folds(registry.stored_model_rows(spark, sf_dir)), "folded")
    error = (F.col(S.TARGET) - F.col(PREDICTION)) * (F.col(S.TARGET) - F.col(PREDICTION))

    def figures(fitter):
        return validation.out_of_fold(folded, fitter, 5, keep=[S.RECORD_ID, S.TARGET]).agg(
            F.count("*").alias("n"), F.countDistinct(S.RECORD_ID).alias("ids"),
            F.count_if(F.col(PREDICTION).isNull()).alias("none"), F.avg(error).alias("mse"),
        ).first()

    own, base = figures(regressors.candidate_models()[regressors.RIDGE]), figures(regressors.fit_median)
    return _figures(spark, lignes=own.n, distinctes=own.ids, sans_prediction=own.none, meilleur_que_la_mediane=own.mse < base.mse)


@check(variables=str(len(S.MODEL_FEATURES)), ordre="1", constante="0")
def m16_importance_checks(spark, sf_dir):
    """Every feature is ranked; shuffling one for a model that ignores it changes nothing."""
    rows = registry.stored_model_rows(spark, sf_dir)
    (model,) = regressors.fit_ridge_lanes(rows, [None])
    found = validation.permutation_importance(rows, model, repeats=20).collect()
    values = [r.importance for r in found]
    ignored = validation.permutation_importance(rows, regressors.fit_median(rows), repeats=1).collect()
    return _figures(
        spark, variables=len({r.variable for r in found}), ordre=values == sorted(values, reverse=True),
        constante=sum(abs(r.importance) for r in ignored),
    )


@check(lignes="n", negatives="0", ecarts="0")
def m17_scoring_checks(spark, sf_dir):
    """Served scores are the model's own predictions, cut off at 0."""
    rows = registry.stored_model_rows(spark, sf_dir)
    model = regressors.fit_ridge(rows)
    names = {**{v: k for k, v in S.SCORING_COUNTS.items()}, S.PERIOD: "annee", S.CATEGORY: "categorie"}
    given = rows.select(S.RECORD_ID, *S.MODEL_FEATURES).withColumnsRenamed(names)
    served = score(given, model, regressors.RIDGE)[0]
    value = next(n for n, kind in served.dtypes if kind == "double")
    own = model.transform(rows).select(S.RECORD_ID, F.col(PREDICTION).alias("_own"))
    row = served.join(own, S.RECORD_ID).agg(
        F.count("*").alias("lignes"), F.count_if(F.col(value) < 0).alias("negatives"),
        F.count_if(F.abs(F.col(value) - F.greatest("_own", F.lit(0.0))) > 0.00501).alias("ecarts"),
    ).first()
    return _figures(spark, **row.asDict())


@check(observations="n", modeles="4", importances=str(len(S.MODEL_FEATURES)), meilleur_present="1")
def m18_document_checks(spark, sf_dir):
    stored, found = registry._comparison(spark, sf_dir)
    importances = validation.permutation_importance(stored, found.best_model)
    row = validation.regression_metrics(found, importances, stored.count()).first()
    return _figures(
        spark, observations=row.nombre_observations, modeles=len(row.resultats),
        importances=len(row.importance_variables_exploratoire),
        meilleur_present=row.meilleur_modele in [r.modele for r in row.resultats],
    )


@check(COARSE_CLEAN, lignes="n", sans_groupe="0", sans_niveau="0")
def x1_stage_checks(spark, sf_dir):
    rows = registry.x1_prepare_stages(spark, sf_dir).collect()
    return _figures(
        spark, lignes=sum(r.nombre for r in rows), sans_groupe=sum(r[clustering.CLUSTER] is None for r in rows),
        sans_niveau=sum(r[rules.LEVEL] is None for r in rows),
    )
