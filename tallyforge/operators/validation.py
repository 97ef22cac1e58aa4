"""Cross-validation, diagnostics, leaderboard, prediction table and importances."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import round_sql
from tallyforge.operators.folds import FOLD, period_folds, shuffled_folds
from tallyforge.operators.importance import block_importance, readable
from tallyforge.operators.regressors import PREDICTION, Fitter
from tallyforge.operators.reshape import one_row
from tallyforge.runtime import in_parallel, materialize

ACTUAL = "Valeur_reelle"
PREDICTED = "Prediction_CV"
KEYS = [S.RECORD_ID, S.PERIOD, S.CATEGORY, S.LABEL]
PERIOD_FOLD = "_period_fold"


def out_of_fold(
    df: DataFrame, fitter: Fitter, folds: int, fold: str = FOLD, keep: Iterable[str] = KEYS, target: str = S.TARGET, parallelism: int = 4
) -> DataFrame:
    """Held-out predictions: every fold is predicted by a model fitted on the others.

    A fitter with lanes fits all of them in shared passes.
    """
    lanes = getattr(fitter, "lanes", None)
    if lanes:
        return held_out_predictions(df, lanes(df, [(fold, i) for i in range(folds)]), fold, keep, target)

    def fit(number: int) -> PipelineModel:
        return fitter(df.where(F.col(fold) != number))

    models = in_parallel(df.sparkSession, fit, range(folds), parallelism)
    return held_out_predictions(df, models, fold, keep, target)


def held_out_predictions(
    df: DataFrame, models: list[PipelineModel], fold: str = FOLD, keep: Iterable[str] = KEYS, target: str = S.TARGET
) -> DataFrame:
    """Each row predicted by the model of its fold; SQL models share one scan, others take one each."""
    shown = [*keep, f"{fold} as {FOLD}", f"cast({target} as double) as {ACTUAL}"]
    texts = [_prediction_sql(model) for model in models]
    if all(texts):
        cases = " ".join(f"when {number} then {sql}" for number, sql in enumerate(texts))
        return df.where(F.col(fold).between(0, len(models) - 1)).selectExpr(*shown, f"case {fold} {cases} end as {PREDICTION}")
    parts = [
        model.transform(df.where(F.col(fold) == number)).selectExpr(*shown, PREDICTION)
        for number, model in enumerate(models)
    ]
    return reduce(DataFrame.unionByName, parts)


def _prediction_sql(model: PipelineModel) -> str | None:
    """The expression of a model that is one SQL projection."""
    if len(model.stages) != 1 or not isinstance(model.stages[0], SQLTransformer):
        return None
    statement = model.stages[0].getStatement()
    begin, end = "SELECT *, ", f" AS {PREDICTION} FROM __THIS__"
    return statement[len(begin) : -len(end)] if statement.startswith(begin) and statement.endswith(end) else None


def fold_scores(predictions: DataFrame) -> DataFrame:
    """MAE, MSE and R2 of each fold; a constant target scores 1 when met and 0 otherwise."""
    error = f"({ACTUAL} - {PREDICTION})"
    return predictions.groupBy(FOLD).agg(
        F.expr(f"avg(abs{error}) as mae"),
        F.expr(f"avg({error} * {error}) as mse"),
        F.expr(
            f"case when var_pop({ACTUAL}) > 0 then 1 - avg({error} * {error}) / var_pop({ACTUAL}) "
            f"when avg({error} * {error}) = 0 then 1D else 0D end as r2"
        ),
    )


def cv_summary(predictions: DataFrame) -> DataFrame:
    """One row over the folds: mean MAE, root of the mean MSE, mean and spread of R2."""
    return fold_scores(predictions).agg(
        F.expr(f"{round_sql('avg(mae)', 4)} as mae"),
        F.expr(f"{round_sql('sqrt(avg(mse))', 4)} as rmse"),
        F.expr(f"{round_sql('avg(r2)', 4)} as r2"),
        F.expr(f"{round_sql('stddev_pop(r2)', 4)} as r2_ecart_type"),
    )


def training_diagnostics(predictions: DataFrame) -> DataFrame:
    """Fit quality on the training rows, predictions clipped at 0."""
    error = f"({ACTUAL} - greatest({PREDICTION}, 0D))"
    square = f"avg({error} * {error})"
    return predictions.agg(
        F.expr(f"{round_sql(f'avg(abs{error})', 4)} as mae_entrainement"),
        F.expr(f"{round_sql(f'sqrt({square})', 4)} as rmse_entrainement"),
        F.expr(f"{round_sql(f'1 - {square} / nullif(var_pop({ACTUAL}), 0)', 4)} as r2_entrainement"),
    )


def prediction_table(predictions: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Clipped, rounded predictions; errors are taken from the rounded value."""
    clipped = round_sql(f"greatest({PREDICTION}, 0D)", 2)
    shown = predictions.selectExpr(*keys, ACTUAL, f"{clipped} as {PREDICTED}")
    return shown.selectExpr(
        "*",
        f"{round_sql(f'abs({ACTUAL} - {PREDICTED})', 2)} as Erreur_absolue",
        f"{round_sql(f'{ACTUAL} - {PREDICTED}', 2)} as Residu",
    )


def leaderboard(results: DataFrame, rmse: str = "validation_kfold.rmse") -> DataFrame:
    return results.orderBy(rmse, "modele")


def best_model_name(results: DataFrame, rmse: str = "validation_kfold.rmse") -> str:
    return results.agg(F.min_by("modele", F.struct(rmse, "modele"))).first()[0]


@dataclass
class Comparison:
    results: DataFrame
    best_name: str
    best_model: PipelineModel
    predictions: DataFrame


def evaluate_models(df: DataFrame, models: dict[str, Fitter], splits: int = 5, seed: int = 42, parallelism: int = 4) -> Comparison:
    """Compare models under shuffled and leave-one-period-out folds; best by shuffled RMSE.

    ``df`` should be a stored table. The held-out predictions of the best model are kept,
    so it is not fitted again for them.
    """
    wanted = list(dict.fromkeys([*KEYS, *S.MODEL_FEATURES, S.TARGET]))
    folded = shuffled_folds(df.select(*wanted), splits, seed)
    folded, periods = period_folds(folded, column=PERIOD_FOLD)
    folded = materialize(folded, "folded")
    rows, held_out, fitted = [], {}, {}
    for name, fitter in models.items():
        lanes = getattr(fitter, "lanes", None)
        if lanes:
            sets = [None, *((FOLD, i) for i in range(splits)), *((PERIOD_FOLD, i) for i in range(periods))]
            fitted[name], *others = lanes(folded, sets)
            found = held_out_predictions(folded, others[:splits])
            by_period = held_out_predictions(folded, others[splits:], PERIOD_FOLD)
        else:
            found = out_of_fold(folded, fitter, splits, parallelism=parallelism)
            by_period = out_of_fold(folded, fitter, periods, PERIOD_FOLD, parallelism=parallelism)
            fitted[name] = fitter(folded)
        held_out[name] = materialize(found, "held_out")
        on_training = fitted[name].transform(folded).selectExpr(
            f"cast({S.TARGET} as double) as {ACTUAL}", PREDICTION
        )
        kfold = cv_summary(held_out[name]).first().asDict()
        period = cv_summary(by_period).first().asDict()
        training = training_diagnostics(on_training).first().asDict()
        rows.append((name, kfold, period, *training.values()))
    block = "struct<mae:double,rmse:double,r2:double,r2_ecart_type:double>"
    results = df.sparkSession.createDataFrame(
        rows,
        f"modele string, validation_kfold {block}, validation_par_periode {block}, "
        "mae_entrainement double, rmse_entrainement double, r2_entrainement double",
    )
    results = results.selectExpr(
        "*",
        "validation_kfold.mae as mae_cv",
        "validation_kfold.rmse as rmse_cv",
        "validation_kfold.r2 as r2_cv",
        "validation_kfold.r2_ecart_type as r2_cv_ecart_type",
    )
    best = best_model_name(results)
    return Comparison(results, best, fitted[best], prediction_table(held_out[best]))


def dense_index(df: DataFrame, column: str = "_index") -> DataFrame:
    """Number the rows of a stored table 0..n-1 from per-partition counts, without a sort."""
    numbered = materialize(
        df.select("*", F.monotonically_increasing_id().alias("_id")), "numbered"
    ).withColumn("_part", F.expr("shiftright(_id, 33)"))
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = parts.selectExpr(
        "_part",
        "coalesce(sum(_size) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before",
    )
    within = "_id - shiftleft(_part, 33)"
    return numbered.join(offsets, "_part").withColumn(column, F.expr(f"_before + {within}")).drop(
        "_id", "_part", "_before"
    )


def permutation_importance(
    df: DataFrame, model: PipelineModel, features: list[str] = S.MODEL_FEATURES, target: str = S.TARGET, repeats: int = 20, seed: int = 42, key: str = S.RECORD_ID
) -> DataFrame:
    """Mean increase of the absolute error when one feature is shuffled, largest first.

    A model whose terms or trees are known is scored by what a swap changes, in blocks of rows
    (:mod:`importance`). For any other, row *i* takes the feature from row ``(a * i + b) mod n`` with ``a`` prime to ``n``,
    after the rows were put in the order of a hash of ``key``, which tells rows with the same
    values apart. One join per repeat brings all features of the
    partner row at once, and every feature is then swapped in on its own.
    """
    if key not in df.columns:
        df = materialize(df.withColumn(key, F.monotonically_increasing_id()), "identified")
    form = readable(model)
    if form is not None:
        found = block_importance(df, form, list(features), target, repeats, seed, key)
        shown = found.select("variable", F.expr(f"{round_sql('more', 4)} as importance"))
        return shown.orderBy(F.col("importance").desc(), "variable")
    spread = df.select(*features, target, F.expr(f"xxhash64({key}, {seed}) as _order"))
    rows = materialize(dense_index(spread.repartitionByRange("_order")).drop("_order"), "indexed")
    size = rows.count()
    shifts = [_affine(size, seed, repeat) for repeat in range(repeats)]
    moved = ", ".join(f"struct({r} as _repeat, pmod({a}L * _index + {b}L, {size}L) as _partner)" for r, (a, b) in enumerate(shifts))
    turns = rows.selectExpr("*", f"inline(array({moved}))")
    partner = rows.selectExpr("_index as _partner", *[f"{c} as _other_{c}" for c in features])
    paired = turns.join(partner, "_partner")
    swaps = ", ".join(
        "struct(" + ", ".join([f"'{chosen}' as _swapped", *[f"{'_other_' + c if c == chosen else c} as _new_{c}" for c in features]]) + ")"
        for chosen in features
    )
    swapped = paired.selectExpr("_repeat", target, f"inline(array({swaps}))").selectExpr(
        "_repeat", "_swapped", target, *[f"_new_{c} as {c}" for c in features]
    )
    error = f"abs({target} - {PREDICTION})"
    base = model.transform(rows).agg(F.expr(f"avg({error})")).first()[0]
    return (
        model.transform(swapped)
        .groupBy("_swapped")
        .agg(F.expr(f"{round_sql(f'avg({error}) - {base!r}D', 4)} as importance"))
        .withColumnRenamed("_swapped", "variable")
        .orderBy(F.col("importance").desc(), "variable")
    )


def _affine(size: int, seed: int, repeat: int) -> tuple[int, int]:
    """Multiplier prime to ``size`` and offset; the product stays within 64 bits."""
    bound = max(1, min(size, 2**62 // max(size, 1)))
    a = (seed * 7919 + (repeat + 1) * 104_729) % bound or 1
    while math.gcd(a, size) != 1:
        a = a % bound + 1
    return a, (seed + 15_485_863 * (repeat + 1)) % max(size, 1)


def regression_metrics(comparison: Comparison, importances: DataFrame, rows: int) -> DataFrame:
    """One-row metric document, results by shuffled RMSE."""
    results = comparison.results.agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("validation_kfold.rmse").alias("_rank"), *comparison.results.columns))
        ).alias("ranked")
    )
    fields = ", ".join(f"r.{c} as {c}" for c in comparison.results.columns)
    ranked = results.selectExpr(f"transform(ranked, r -> struct({fields})) as resultats")
    listed = importances.agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("importance", "variable")))).alias(
            "importance_variables_exploratoire"
        )
    )
    return one_row([ranked, listed]).withColumns(
        {
            "cible": F.lit(S.TARGET),
            "meilleur_modele": F.lit(comparison.best_name),
            "nombre_observations": F.lit(rows).cast("long"),
        }
    )
