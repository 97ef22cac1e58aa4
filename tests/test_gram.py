import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.operators import gram, regressors, validation
from tallyforge.operators.regressors import PREDICTION


def frame(n=160, gaps=True):
    rng = np.random.default_rng(9)
    data = pd.DataFrame({c: rng.poisson(3 + j, n).astype(float) for j, c in enumerate(S.NUMERIC_FEATURES)})
    data[S.RECORD_ID] = [f"R{i}" for i in range(n)]
    data[S.PERIOD] = rng.choice(["2023", "2024", "2025"], n)
    data[S.CATEGORY] = rng.choice(["C'0", "C1", "C2", "rare"], n, p=[0.4, 0.3, 0.28, 0.02])
    data[S.LABEL] = "x"
    data[S.TARGET] = (data[S.NUMERIC_FEATURES[0]] * 2 + rng.normal(0, 1, n)).round() + 5 * (data[S.CATEGORY] == "C1")
    data["fold"] = rng.integers(0, 4, n)
    if gaps:
        data.loc[rng.random(n) < 0.2, S.NUMERIC_FEATURES[1]] = None
        data.loc[rng.random(n) < 0.1, S.CATEGORY] = None
    return data


def table(spark, data):
    kinds = {S.RECORD_ID: "string", S.PERIOD: "string", S.CATEGORY: "string", S.LABEL: "string", "fold": "int", "half": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in data.columns)
    clean = data.astype(object).where(data.notna(), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], schema)


def closed_form(train, test, alpha=10.0):
    """The pipeline by plain numpy: fill, standardise, one-hot, ridge with a free intercept."""
    numeric = train[S.NUMERIC_FEATURES].astype(float)
    fill = numeric.apply(lambda c: np.sort(c.dropna())[[(c.count() - 1) // 2, c.count() // 2]].mean())
    counts = {c: train[c].value_counts() for c in S.CATEGORICAL_FEATURES}
    modes = {c: min(v[v == v.max()].index) for c, v in counts.items()}

    def encode(rows):
        values = rows[S.NUMERIC_FEATURES].astype(float).fillna(fill)
        filled = numeric.fillna(fill)
        spread = filled.std(ddof=0).replace(0, 1)
        parts = [((values - filled.mean()) / spread).to_numpy()]
        for c in S.CATEGORICAL_FEATURES:
            own = rows[c].fillna(modes[c])
            parts.append(np.array([[float(v == level) for level in sorted(counts[c].index)] for v in own]))
        return np.hstack(parts)

    x, y = encode(train), train[S.TARGET].to_numpy(float)
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return (encode(test) - x.mean(axis=0)) @ weights + y.mean()


@pytest.mark.parametrize("gaps", [False, True])
def test_lanes_are_the_closed_form(spark, gaps):
    data = frame(gaps=gaps)
    rows = table(spark, data).repartition(5).cache()
    lanes = [None, *(("fold", i) for i in range(4))]
    for lane, model in zip(lanes, regressors.fit_ridge_lanes(rows, lanes), strict=True):
        train = data if lane is None else data[data.fold != lane[1]]
        found = {r[S.RECORD_ID]: r[PREDICTION] for r in model.transform(rows).collect()}
        assert [found[i] for i in data[S.RECORD_ID]] == pytest.approx(closed_form(train, data), abs=1e-6)


def test_out_of_fold_equals_separate_fits_and_scans_once(spark):
    rows = table(spark, frame(gaps=False)).cache()
    fitter = regressors.candidate_models()[regressors.RIDGE]
    together = validation.out_of_fold(rows, fitter, 4)
    apart = validation.out_of_fold(rows, regressors.fit_ridge, 4)
    both = together.join(apart.select(S.RECORD_ID, F.col(PREDICTION).alias("other")), S.RECORD_ID)
    assert both.count() == 160
    assert both.agg(F.max(F.abs(F.col(PREDICTION) - F.col("other")))).first()[0] < 1e-6
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation [") + plan.count("LogicalRDD") <= 2 and "Union" not in plan


def test_two_fold_columns_share_a_pass(spark):
    data = frame(gaps=False)
    data["half"] = np.arange(len(data)) % 2
    rows = table(spark, data)
    base = gram.Base(rows, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
    found = gram.fold_matrices(rows, base, ["fold", "half"], S.TARGET)
    assert {c for c, _ in found} == {"fold", "half"} and len(found) == 6
    sums = [sum(m for (c, _), m in found.items() if c == name) for name in ("fold", "half")]
    assert np.allclose(*sums) and sums[0][0, 0] == len(data)


def test_unseen_category_and_width(spark, monkeypatch):
    rows = table(spark, frame())
    (model,) = regressors.fit_ridge_lanes(rows, [None])
    odd = rows.limit(1).withColumn(S.CATEGORY, F.lit("new")).withColumn(S.PERIOD, F.lit("2050"))
    assert np.isfinite(model.transform(odd).first()[PREDICTION])
    monkeypatch.setattr(gram, "MOST_COLUMNS", 5)
    with pytest.raises(ValueError):
        gram.Base(rows, S.NUMERIC_FEATURES, S.CATEGORICAL_FEATURES)
