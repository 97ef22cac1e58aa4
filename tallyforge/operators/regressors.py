"""Preprocessing and the four candidate regressors, each fitted as one PipelineModel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Row, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import number_sql
from tallyforge.operators import boosting, forest, gram
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.runtime import in_parallel

FEATURES = "features"
PREDICTION = "prediction"
LABEL = "_label"

# The names under which models are reported.
MEDIAN = "Référence médiane"
RIDGE = "Ridge"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"


def most_frequent(df: DataFrame, column: str) -> str | None:
    """Most frequent present value, the smallest one on ties."""
    row = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.col("count").desc(), column)
        .first()
    )
    return row[0] if row else None


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Imputation:
    """Replacement values; empty where nothing was missing."""

    medians: dict[str, float]
    modes: dict[str, str]

    def numeric(self, column: str) -> str:
        value = f"cast({column} as double)"
        if column in self.medians:
            return f"coalesce({value}, {number_sql(self.medians[column])})"
        return value

    def category(self, column: str) -> str:
        if column in self.modes:
            return f"coalesce({column}, {_quoted(self.modes[column])})"
        return column


def _missing_sql(columns: list[str]) -> list[Column]:
    return [F.expr(f"count_if({c} is null) as n_{c}") for c in columns]


def fit_imputation(
    df: DataFrame, numeric: list[str], categorical: list[str], missing: dict[str, int] | None = None
) -> Imputation:
    """Medians and modes of the columns with gaps; ``missing`` spares the counting pass."""
    if missing is None:
        row = df.agg(*_missing_sql([*numeric, *categorical])).first()
        missing = {c: row[f"n_{c}"] for c in [*numeric, *categorical]}
    gaps = [c for c in numeric if missing[c]]
    medians = {c: q[0] for c, q in exact_quantiles(df, gaps, [0.5]).items()} if gaps else {}
    modes = {c: most_frequent(df, c) for c in categorical if missing[c]}
    return Imputation(
        {c: m if m is not None else 0.0 for c, m in medians.items()},
        {c: m for c, m in modes.items() if m is not None},
    )


@dataclass(frozen=True)
class Preprocessor:
    stages: list[Transformer]
    rows: int
    label_spread: float


def fit_preprocessor(
    df: DataFrame,
    numeric: list[str] = S.NUMERIC_FEATURES,
    categorical: list[str] = S.CATEGORICAL_FEATURES,
    target: str | None = None,
) -> Preprocessor:
    """Impute, standardise, one-hot and assemble; unseen categories become all zeros.

    Without gaps everything comes from one aggregate over the training rows; only a
    column with gaps costs the median or mode and a second aggregate. Category lists are
    as long as the one-hot part of a row, so they fit wherever a row does.
    """
    every = [*numeric, *categorical]

    def statistics(fill: Imputation) -> Row:
        return df.agg(
            F.expr("count(*) as _rows"),
            F.expr(f"coalesce(stddev_pop({target}), 0D) as _spread") if target else F.lit(0.0).alias("_spread"),
            *_missing_sql(every),
            *[F.expr(f"sort_array(collect_set({fill.category(c)})) as l_{c}") for c in categorical],
            *[F.expr(f"avg({fill.numeric(c)}) as m_{c}") for c in numeric],
            *[F.expr(f"stddev_pop({fill.numeric(c)}) as s_{c}") for c in numeric],
        ).first()

    fill = Imputation({}, {})
    stats = statistics(fill)
    missing = {c: stats[f"n_{c}"] for c in every}
    if any(missing.values()):
        fill = fit_imputation(df, numeric, categorical, missing)
        stats = statistics(fill)
    scaled = [
        f"({fill.numeric(c)} - {number_sql(stats[f'm_{c}'])}) / {number_sql(stats[f's_{c}'] or 1.0)} AS _z_{c}"
        for c in numeric
    ]
    filled = [f"coalesce({fill.category(c)}, '') AS _c_{c}" for c in categorical]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(scaled + filled)} FROM __THIS__")
    indexers = [
        StringIndexerModel.from_labels(
            stats[f"l_{c}"], inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep"
        )
        for c in categorical
    ]
    encoder = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in categorical],
        outputCols=[f"_h_{c}" for c in categorical],
        dropLast=True,
        handleInvalid="error",
    ).fit(PipelineModel([prepare, *indexers]).transform(df))
    vector = VectorAssembler(
        inputCols=[f"_z_{c}" for c in numeric] + [f"_h_{c}" for c in categorical], outputCol=FEATURES
    )
    return Preprocessor([prepare, *indexers, encoder, vector], stats["_rows"], stats["_spread"])


def _prepared(df: DataFrame, stages: list[Transformer], target: str) -> DataFrame:
    vectors = PipelineModel(stages).transform(df)
    return vectors.select(FEATURES, F.col(target).cast("double").alias(LABEL))


def fit_median(df: DataFrame, target: str = S.TARGET) -> PipelineModel:
    """Constant prediction: the exact training median."""
    middle = exact_quantiles(df, [target], [0.5])[target][0]
    return _sql_model({}, number_sql(middle))


def fit_ridge(df: DataFrame, target: str = S.TARGET, alpha: float = 10.0) -> PipelineModel:
    """Least squares with penalty ``alpha`` and a free intercept, solved in one pass.

    The library scales its penalty by the row count and the label deviation, hence the
    conversion.
    """
    prepared = fit_preprocessor(df, target=target)
    stages = prepared.stages
    line = LinearRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        predictionCol=PREDICTION,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha * prepared.label_spread / prepared.rows,
    )
    return PipelineModel([*stages, line.fit(_prepared(df, stages, target))])


def fit_forest_lanes(
    df: DataFrame, held_out: list[tuple[str, int] | None], target: str = S.TARGET, trees: int = 350, depth: int = 8,
    bins: int = 128, seed: int = 42, key: str = S.RECORD_ID,
) -> list[PipelineModel]:
    """Random forests (Breiman, 2001) of several training sets in shared passes, see :mod:`forest`.

    Every split may use every feature and leaves two drawn rows on either side. Gaps are filled with
    the medians and modes of a lane's own rows; cuts come from all rows of ``df``, labels never do.
    """
    numeric, categorical = S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES
    row = df.agg(*_missing_sql([*numeric, *categorical])).first()
    gaps = any(row)
    fills = []
    for lane in held_out:
        own = df if lane is None else df.where(F.col(lane[0]) != lane[1])
        fills.append(fit_imputation(own, numeric, categorical) if gaps else Imputation({}, {}))
    plain = {**{c: f"cast({c} as double)" for c in numeric}, **{c: c for c in categorical}}
    binning = boosting.fit_binning(df, {c: plain[c] for c in numeric}, {c: c for c in categorical}, bins)
    folds = sorted({c for c, _ in filter(None, held_out)})
    told = [c for c in (key,) if c in df.columns]
    rows = df.select(
        F.col(target).cast("double").alias("label"),
        F.xxhash64(*told, *numeric, *categorical, target).alias(forest.KEY),
        *[F.col(c).cast("int").alias(c) for c in folds],
        *[F.expr(sql).alias(c) for c, sql in plain.items()],
    )

    def filled(fill: Imputation) -> list[int]:
        values = [np.array([fill.medians.get(c, 0.0)]) for c in numeric]
        names = [np.array([fill.modes.get(c, "")], object) for c in categorical]
        return binning.bins([*values, *names])[0].tolist()

    grown = forest.grow(rows, binning, held_out, [filled(f) for f in fills], trees, depth, 2, seed)
    models = []
    for fill, own in zip(fills, grown, strict=True):
        # A forest is the sum of its trees' shares.
        shares = [boosting.Tree(t.feature, t.cut, t.equal, t.value / trees) for t in own]
        values = {c: f"coalesce({fill.numeric(c)}, 0D)" for c in numeric}
        names = {c: f"coalesce({fill.category(c)}, '')" for c in categorical}
        models.append(PipelineModel([boosting.TreeSum.of(boosting.Fit(0.0, shares), binning, values, names, PREDICTION)]))
    return models


def fit_forest_regressor(df: DataFrame, target: str = S.TARGET, trees: int = 350, **settings) -> PipelineModel:
    """One forest over all rows, see :func:`fit_forest_lanes`."""
    return fit_forest_lanes(df, [None], target, trees, **settings)[0]


def fit_boosting_lanes(
    df: DataFrame,
    held_out: list[tuple[str, int] | None],
    target: str = S.TARGET,
    rounds: int = 220,
    rate: float = 0.035,
    depth: int = 3,
    alpha: float = 0.9,
    save_every: int = boosting.SAVE_EVERY,
) -> tuple[list[PipelineModel], list[boosting.Fit]]:
    """Gradient boosting with Huber loss (Friedman, 2001) on several training sets in shared passes.

    A lane trains on all rows (None) or on those whose fold column holds another number. Each
    round fits a tree to residuals cut at their ``alpha`` quantile and moves every leaf by its
    median residual plus the mean clipped rest. Bins and fills come from all rows of ``df``,
    labels never do.
    """
    numeric, categorical = S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES
    fill = fit_imputation(df, numeric, categorical)
    values = {c: f"coalesce({fill.numeric(c)}, 0D)" for c in numeric}
    names = {c: f"coalesce({fill.category(c)}, '')" for c in categorical}
    binning = boosting.fit_binning(df, values, names)

    def start(lane: tuple[str, int] | None) -> float:
        own = df if lane is None else df.where(F.col(lane[0]) != lane[1])
        return exact_quantiles(own, [target], [0.5])[target][0]

    starts = in_parallel(df.sparkSession, start, held_out)
    folds = sorted({c for c, _ in filter(None, held_out)})
    rows = df.select(
        F.col(target).cast("double").alias("label"),
        *[F.col(c).cast("int").alias(c) for c in folds],
        *[F.expr(sql).alias(c) for c, sql in {**values, **names}.items()],
    )
    fits = boosting.boost(rows, binning, held_out, starts, rounds, rate, depth, alpha, save_every)
    return [PipelineModel([boosting.TreeSum.of(f, binning, values, names, PREDICTION)]) for f in fits], fits


def fit_boosting(df: DataFrame, target: str = S.TARGET, rounds: int = 220, rate: float = 0.035, **settings) -> PipelineModel:
    """One boosted model over all rows, see :func:`fit_boosting_lanes`."""
    return fit_boosting_lanes(df, [None], target, rounds, rate, **settings)[0][0]


def fit_ridge_lanes(
    df: DataFrame, held_out: list[tuple[str, int] | None], target: str = S.TARGET, alpha: float = 10.0
) -> list[PipelineModel]:
    """The ridge fits of several training sets from one pass over ``df``, see :mod:`gram`."""
    found = gram.ridge_lanes(df, held_out, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES, target, alpha)
    return [_sql_model(terms, total) for terms, total in found]


def _sql_model(terms: dict[str, str], total: str) -> PipelineModel:
    """A model that is one projection; what it adds up stays on the fitted object, not in its file."""
    stage = SQLTransformer(statement=f"SELECT *, {total} AS {PREDICTION} FROM __THIS__")
    stage.additive_terms = terms, total
    return PipelineModel([stage])


Fitter = Callable[[DataFrame], PipelineModel]


@dataclass(frozen=True)
class LaneFitter:
    """A fitter that can also fit several training sets together, each all rows or all but a fold."""

    one: Fitter
    lanes: Callable[[DataFrame, list[tuple[str, int] | None]], list[PipelineModel]]

    def __call__(self, df: DataFrame) -> PipelineModel:
        return self.one(df)


def candidate_models(trees: int = 350, rounds: int = 220) -> dict[str, Fitter]:
    return {
        MEDIAN: fit_median,
        RIDGE: LaneFitter(fit_ridge, fit_ridge_lanes),
        FOREST: LaneFitter(
            lambda df: fit_forest_regressor(df, trees=trees), lambda df, held_out: fit_forest_lanes(df, held_out, trees=trees)
        ),
        BOOSTING: LaneFitter(
            lambda df: fit_boosting(df, rounds=rounds),
            lambda df, held_out: fit_boosting_lanes(df, held_out, rounds=rounds)[0],
        ),
    }
