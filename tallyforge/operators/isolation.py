"""Isolation forest: trees grown on bounded samples, rows scored in Arrow batches.

The method is the published one (Liu, Ting and Zhou, 2008). Every tree sees at most
``sample`` rows, so all trees together are a few megabytes whatever the table size.
Contamination only moves the threshold, so one fit serves every contamination value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import round_half_even, round_sql
from tallyforge.operators import anomaly_rules as rules
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.operators.reshape import long_rows, one_row
from tallyforge.runtime import materialize

SWEEP = [0.03, 0.05, 0.08, 0.10, 0.15]
ISOLATION = "_isolation"
_TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, below array<int>, "
    "above array<int>, path array<double>"
)


@dataclass(frozen=True)
class Forest:
    """Node arrays, one row per tree, padded to the same width."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    path: np.ndarray
    depth: int
    expected_path: float


def expected_path(rows: int) -> float:
    """Mean path length of an unsuccessful search among ``rows`` keys."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def _draw_samples(df: DataFrame, features: list[str], key: str, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows per tree, about twice the sample size, drawn for each tree from the whole table.

    A row draws trees by hashes of its key, so often that a tree is met by two samples of rows;
    a table below that size goes to every tree whole. Hashes make the draw repeatable when
    a task runs again.
    """
    chosen = df.selectExpr(key, *[f"cast({c} as double) as {c}" for c in features])
    if rows <= 2 * sample:
        tree = f"explode(sequence(0, {trees - 1}))"
    else:
        rate = 2 * sample * trees / rows
        draws = math.ceil(rate)
        bar = int(rate / draws * 2**40)
        hits = f"filter(sequence(1, {draws}), j -> pmod(xxhash64({key}, {seed}, j), {2**40}L) < {bar}L)"
        picks = f"transform({hits}, j -> cast(pmod(xxhash64({key}, {seed + 1}, j), {trees}) as int))"
        tree = f"explode(array_distinct({picks}))"
    return chosen.selectExpr(key, *features, f"{tree} as tree").withColumn(
        "place", F.expr(f"xxhash64({key}, tree, {seed + 2})")
    )


def _tree_grower(features: list[str], sample: int, seed: int):
    # Plain data, so that tasks need not import this package.
    leaf_path = [expected_path(rows) for rows in range(sample + 1)]

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        values = group.nsmallest(sample, "place")[features].to_numpy()
        limit = math.ceil(math.log2(max(sample, 2)))
        random = np.random.default_rng([seed, tree])
        feature, threshold, below, above, path = [], [], [], [], []
        waiting = [(values, 0, -1, False)]
        while waiting:
            rows, depth, parent, is_above = waiting.pop()
            node = len(feature)
            if parent >= 0:
                (above if is_above else below)[parent] = node
            low, high = rows.min(axis=0), rows.max(axis=0)
            varying = np.flatnonzero(high > low)
            split = depth < limit and varying.size > 0
            column = int(random.choice(varying)) if split else -1
            cut = float(random.uniform(low[column], high[column])) if split else 0.0
            feature.append(column)
            threshold.append(cut)
            below.append(node)
            above.append(node)
            path.append(0.0 if split else depth + leaf_path[len(rows)])
            if split:
                small = rows[:, column] <= cut
                waiting.append((rows[small], depth + 1, node, False))
                waiting.append((rows[~small], depth + 1, node, True))
        return pd.DataFrame(
            {
                "tree": [tree],
                "feature": [feature],
                "threshold": [threshold],
                "below": [below],
                "above": [above],
                "path": [path],
            }
        )

    return grow


def fit_forest(
    df: DataFrame,
    features: list[str] = S.ANOMALY_FEATURES,
    key: str = S.RECORD_ID,
    trees: int = 400,
    sample: int = 256,
    seed: int = 42,
) -> Forest:
    rows = df.count()
    if rows == 0:
        raise ValueError("cannot fit a forest on an empty table")
    sample = min(sample, rows)
    drawn = _draw_samples(df, features, key, rows, trees, sample, seed)
    grown = drawn.groupBy("tree").applyInPandas(_tree_grower(features, sample, seed), _TREE_SCHEMA)
    # One bounded row per tree: at most 2 * sample - 1 nodes each.
    nodes = sorted(grown.collect(), key=lambda row: row.tree)
    width = max(len(row.feature) for row in nodes)

    def padded(name: str, kind: type) -> np.ndarray:
        table = np.zeros((len(nodes), width), dtype=kind)
        for i, row in enumerate(nodes):
            table[i, : len(row[name])] = row[name]
        return table

    return Forest(
        features,
        padded("feature", np.int32),
        padded("threshold", np.float64),
        padded("below", np.int32),
        padded("above", np.int32),
        padded("path", np.float64),
        math.ceil(math.log2(max(sample, 2))),
        expected_path(sample),
    )


def isolation_score(spark: SparkSession, forest: Forest) -> Column:
    """Score in (0, 1]; only the feature columns travel to Python."""
    shared = spark.sparkContext.broadcast(
        (forest.feature, forest.threshold, forest.below, forest.above, forest.path)
    )
    depth, scale = forest.depth, forest.expected_path or 1.0

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, below, above, path = shared.value
        trees, width = feature.shape
        base = np.arange(trees, dtype=np.int64) * width
        feature, threshold, below, above, path = (
            table.ravel() for table in (feature, threshold, below, above, path)
        )
        for columns in batches:
            values = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            scores = np.empty(len(values))
            for start in range(0, len(values), 1024):
                block = values[start : start + 1024]
                at = np.tile(base, (len(block), 1))
                picked = np.arange(len(block))[:, None]
                for _ in range(depth):
                    small = block[picked, np.maximum(feature[at], 0)] <= threshold[at]
                    at = base + np.where(small, below[at], above[at])
                scores[start : start + 1024] = np.exp2(-path[at].mean(axis=1) / scale)
            yield pd.Series(scores)

    score_udf = F.pandas_udf(score, "double")
    return score_udf(*[F.col(c).cast("double") for c in forest.features])


def detect_anomalies(
    df: DataFrame,
    contamination: float = 0.08,
    trees: int = 400,
    sample: int = 256,
    seed: int = 42,
    features: list[str] = S.ANOMALY_FEATURES,
    key: str = S.RECORD_ID,
) -> tuple[DataFrame, DataFrame, Forest]:
    """Scores, flags, reasons and levels; the metric document; the forest.

    ``df`` should be a stored table: it is read for the fit, the limits and the scores.
    """
    forest = fit_forest(df, features, key, trees, sample, seed)
    limits = rules.rule_thresholds(df, features)
    scored = materialize(
        rules.with_reasons(df, limits).withColumn(ISOLATION, isolation_score(df.sparkSession, forest)),
        "scored",
    )
    cut = _score_cuts(scored, [contamination])[0]
    flagged = rules.with_flags(scored, F.lit(cut) - F.col(ISOLATION))
    if S.MISSING_LABEL not in flagged.columns:
        flagged = flagged.withColumn(S.MISSING_LABEL, F.lit(False))
    leveled = rules.with_severity(flagged, rules.severity_cuts(flagged))
    metrics = anomaly_metrics(leveled, contamination, limits, contamination_sweep(scored))
    return leveled.drop(ISOLATION), metrics, forest


def _score_cuts(scored: DataFrame, contaminations: list[float]) -> list[float]:
    return exact_quantiles(scored, [ISOLATION], [1 - c for c in contaminations])[ISOLATION]


def contamination_sweep(scored: DataFrame, contaminations: list[float] = SWEEP) -> DataFrame:
    """Flagged rows and share per contamination, from one set of scores."""
    cuts = _score_cuts(scored, contaminations)
    counts = [
        F.count_if(F.col(ISOLATION) > cut).alias(f"n{i}") for i, cut in enumerate(cuts)
    ]
    rows = [
        {
            "contamination": f"double('{c!r}')",
            "nombre_anomalies_ml": f"n{i}",
            "pourcentage": round_sql(f"100 * n{i} / nullif(_rows, 0)", 2),
        }
        for i, c in enumerate(contaminations)
    ]
    return long_rows(scored.agg(F.count("*").alias("_rows"), *counts), [], rows)


def anomaly_metrics(
    leveled: DataFrame, contamination: float, limits: dict[str, float], sweep: DataFrame
) -> DataFrame:
    """One-row metric document."""
    spark = leveled.sparkSession
    counts = leveled.agg(
        F.count("*").alias("nombre_observations"),
        F.count_if(rules.ML_FLAG).alias("nombre_anomalies_ml"),
        F.count_if(rules.RULE_FLAG).alias("nombre_anomalies_regles"),
        F.count_if(rules.FLAG).alias("nombre_anomalies_finales"),
    )
    levels = rules.severity_split(leveled).agg(
        F.map_from_entries(F.collect_list(F.struct(rules.LEVEL, "nombre"))).alias("repartition_severite")
    )
    steps = sweep.agg(
        F.sort_array(F.collect_list(F.struct(*sweep.columns))).alias("sensibilite_contamination")
    )
    table = spark.createDataFrame(list(limits.items()), "variable string, seuil double")
    thresholds = table.agg(
        F.map_from_entries(
            F.collect_list(F.struct("variable", round_half_even(F.col("seuil"), 3)))
        ).alias("seuils_regles")
    )
    return one_row([counts, levels, steps, thresholds]).withColumns(
        {
            "contamination": F.lit(contamination),
            "variables": F.array(*(F.lit(name) for name in limits)),
        }
    )
