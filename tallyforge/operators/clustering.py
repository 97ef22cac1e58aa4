"""K-Means profiles over scaled counts, silhouettes, choice of k and two PCA axes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import number_sql, round_sql
from tallyforge.operators import kmeans
from tallyforge.operators.contracts import check_choice
from tallyforge.operators.kmeans import RAW_LABEL, Centres
from tallyforge.operators.reshape import one_row
from tallyforge.runtime import in_parallel, materialize

CLUSTER = "Cluster"
AXES = ["PCA_1", "PCA_2"]
VECTOR = "_features"
# The least share of a cluster, the field names of the sweep and of the document.
MIN_SHARE = 0.05
LARGEST_K = 6
BLOCK_POINTS = 32_768
LEAST_BLOCK, LEAST_BLOCKS = 4096, 12
NEAR = 1e-6  # of the largest squares, below which distances are taken from differences
TILE_TASKS = 10_000
TILE = 256, 1024  # distances held at once


def scaled_names(features: list[str]) -> list[str]:
    return [f"_z_{c}" for c in features]


def fit_scaler(df: DataFrame, features: list[str] = S.CLUSTER_FEATURES, log: bool = True) -> SQLTransformer:
    """Mean 0 and population deviation 1 per feature, on ``log1p`` counts or raw ones."""
    value = "log1p({0})" if log else "cast({0} as double)"
    stats = df.agg(
        *[F.expr(f"avg({value.format(c)}) as m_{c}") for c in features],
        *[F.expr(f"stddev_pop({value.format(c)}) as s_{c}") for c in features],
    ).first()
    scaled = [
        f"({value.format(c)} - {number_sql(stats[f'm_{c}'])}) / {number_sql(stats[f's_{c}'] or 1.0)} AS {z}"
        for c, z in zip(features, scaled_names(features))
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=scaled_names(features), outputCol=VECTOR)


def scaled_vectors(df: DataFrame, features: list[str], log: bool) -> tuple[DataFrame, SQLTransformer]:
    scaler = fit_scaler(df.select(*features), features, log)
    points = assembler(features).transform(scaler.transform(df.select(*features)))
    return points.select(*scaled_names(features), VECTOR), scaler


def fit_kmeans(
    vectors: DataFrame, k: int, restarts: int, seed: int = 42, features: list[str] = S.CLUSTER_FEATURES
) -> Centres:
    """Best of several seeded fits by within-cluster cost; all restarts share their passes."""
    columns = scaled_names(features)
    return kmeans.fit_all(kmeans.distinct_points(vectors, columns), columns, [k], restarts, seed)[k]


def canonical_labels(model: Centres) -> list[int]:
    """New label per fitted label: larger clusters first, then by centre."""
    centres = [tuple(centre) for centre in model.centres]
    order = sorted(range(len(centres)), key=lambda i: (-model.sizes[i], centres[i]))
    return [order.index(i) for i in range(len(centres))]


def relabel_sql(labels: list[int]) -> str:
    cases = " ".join(f"WHEN {old} THEN {new}" for old, new in enumerate(labels))
    return f"CASE {RAW_LABEL} {cases} END"


# ---------------------------------------------------------------- silhouettes


def euclidean_silhouette(
    points: DataFrame, columns: list[str], label: str, block_points: int = BLOCK_POINTS
) -> float | None:
    """Mean silhouette with plain distances, over weighted distinct points.

    The cost is quadratic in the distinct points and there is no limit to them. Points are
    dealt into blocks of bounded size by their hash; every two blocks meet in one task, which
    takes each distance once and adds it up for both of its points, per cluster. No pair is emitted and no
    block passes through the driver: a point is shuffled once per block. For large tables
    :func:`squared_silhouette` is linear, and a different number.
    """
    weighted = materialize(points.groupBy(*columns, label).agg(F.count("*").alias("n")), "points")
    sizes = {r[0]: r[1] for r in weighted.groupBy(label).agg(F.sum("n")).collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return None
    distinct = weighted.count()
    # Few points make smaller blocks, so that there are tiles for several tasks.
    blocks = max(1, math.ceil(distinct / block_points), min(LEAST_BLOCKS, math.ceil(distinct / LEAST_BLOCK)))
    axes, sums = [f"_x_{i}" for i in range(len(columns))], [f"_sum_{i}" for i in range(len(names))]
    places = F.array(*[F.lit(name) for name in names])
    dealt = weighted.select(
        *[F.col(c).cast("double").alias(x) for c, x in zip(columns, axes)],
        (F.array_position(places, F.col(label)) - 1).cast("int").alias("own"),
        "n",
        F.pmod(F.xxhash64(*columns, label), F.lit(blocks)).cast("int").alias("block"),
        F.monotonically_increasing_id().alias("point"),
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    kinds = ", ".join(["point long, own int, n long", *(f"{s} double" for s in sums)])
    # A tile is little data but much work, so tasks are not to be merged by their size.
    met = met.repartition(min(blocks * (blocks + 1) // 2, TILE_TASKS), "low", "high")
    parts = met.groupBy("low", "high").applyInPandas(_distance_sums(axes, sums), kinds)
    total = parts.groupBy("point", "own", "n").agg(*[F.sum(s).alias(s) for s in sums])
    size = F.element_at(F.array(*[F.lit(int(sizes[name])) for name in names]), F.col("own") + 1)
    at = [F.col(s) / F.lit(int(sizes[name])) for s, name in zip(sums, names)]
    others = [F.when(F.col("own") != i, mean) for i, mean in enumerate(at)]
    inner = F.element_at(F.array(*[F.col(s) for s in sums]), F.col("own") + 1) / F.greatest(size - 1, F.lit(1))
    outer = F.least(*others) if len(others) > 2 else F.coalesce(*others)
    larger = F.greatest(inner, outer)
    width = F.when((size > 1) & (larger > 0), (outer - inner) / larger).otherwise(0.0)
    row = total.agg(F.sum(width * F.col("n")).alias("w"), F.sum("n").alias("n")).first()
    return row.w / row.n


def _distance_sums(axes: list[str], sums: list[str]):
    """Weighted distances between the points of two blocks, or within one, summed per cluster."""

    def weights(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(rows), len(sums)))
        out[np.arange(len(rows)), rows["own"].to_numpy()] = rows["n"]
        return out

    def summed(rows: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=sums)
        for name in ("n", "own", "point"):
            out.insert(0, name, rows[name].to_numpy())
        return out

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        within = rows["low"].iloc[0] == rows["high"].iloc[0]
        first, second = rows[rows["block"] == rows["low"]], rows[rows["block"] == rows["high"]]
        one, two = first[axes].to_numpy(np.float64), second[axes].to_numpy(np.float64)
        of_one, of_two = weights(first), weights(second)
        to_one, to_two = np.zeros_like(of_one), np.zeros_like(of_two)
        for low in range(0, len(one), TILE[0]):
            part = slice(low, low + TILE[0])
            for start in range(low if within else 0, len(two), TILE[1]):
                other = slice(start, start + TILE[1])
                far = distances(one[part], two[other])
                if within:  # every two points once, a point with itself not at all
                    far = np.where(np.arange(start, start + far.shape[1]) > np.arange(low, low + len(far))[:, None], far, 0.0)
                to_one[part] += far @ of_two[other]
                to_two[other] += far.T @ of_one[part]
        if within:
            return summed(first, to_one + to_two)
        return pd.concat([summed(first, to_one), summed(second, to_two)])

    return tile


def distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Plain distances by one product of matrices; those next to nothing by differences, so that 0 is 0."""
    middle = two.mean(0)
    one, two = one - middle, two - middle
    ones, twos = (one * one).sum(1), (two * two).sum(1)
    out = np.column_stack([-2 * one, ones, np.ones(len(one))]) @ np.column_stack([two, np.ones(len(two)), twos]).T
    least = NEAR * (ones.max() + twos.max())
    if out.min() <= least:
        i, j = np.nonzero(out <= least)
        out[i, j] = ((one[i] - two[j]) ** 2).sum(1)
    return np.sqrt(out, out=out)


def squared_silhouette(vectors: DataFrame, label: str, vector: str = VECTOR) -> float:
    """Mean silhouette with squared distances, in one linear pass."""
    evaluator = ClusteringEvaluator(featuresCol=vector, predictionCol=label, metricName="silhouette")
    return evaluator.evaluate(vectors.withColumn(label, F.col(label).cast("double")))


# ---------------------------------------------------------------- choice of k


def evaluate_k(
    vectors: DataFrame, features: list[str], restarts: int = 30, seed: int = 42, metric: str = "squared"
) -> DataFrame:
    """Silhouette and cluster sizes for k from 2 to 6; degenerate fits are left out.

    ``metric`` is ``squared``, whose cost is linear, or ``euclidean``, whose cost is quadratic,
    at any size of the table. The row names the one used.
    """
    columns = scaled_names(features)
    check_choice(metric, ["squared", "euclidean"])
    rows_in = vectors.count()
    points = kmeans.distinct_points(vectors, columns)
    ks = list(range(2, min(LARGEST_K, rows_in - 1) + 1))
    fits = kmeans.fit_all(points, columns, ks, restarts, seed)
    fits = {k: fit for k, fit in fits.items() if (fit.sizes > 0).sum() > 1}
    if metric == "squared":
        widths = kmeans.silhouettes(points, columns, fits) if fits else {}
    else:
        widths = {
            k: euclidean_silhouette(fit.transformer(columns).transform(vectors), columns, RAW_LABEL)
            for k, fit in fits.items()
        }
    found = []
    for k, fit in fits.items():
        sizes = sorted((int(size) for size in fit.sizes if size), reverse=True)
        shown = {str(i): size for i, size in enumerate(sizes)}
        found.append((k, widths[k], metric, sizes[-1], sizes[0], sizes[-1] / rows_in, shown))
    return vectors.sparkSession.createDataFrame(
        found,
        "k int, silhouette double, metrique_silhouette string, taille_min_cluster long, "
        "taille_max_cluster long, ratio_cluster_min double, tailles_clusters map<string,long>",
    )


def choose_k(rows: DataFrame) -> int:
    """Best silhouette among k whose smallest cluster holds 5 %; all k if none does."""
    best = rows.orderBy(
        (F.col("ratio_cluster_min") >= MIN_SHARE).desc(), F.col("silhouette").desc(), "k"
    ).first()
    if best is None:
        raise ValueError("not enough diversity to cluster")
    return int(best.k)


# ---------------------------------------------------------------- PCA


def fit_axes(vectors: DataFrame, features: list[str]) -> tuple[list[str], list[float]]:
    """SQL text of the two axes over the scaled columns, and their variance shares.

    The input is centred already. Each axis is turned so that its largest loading is
    positive.
    """
    model = PCA(k=2, inputCol=VECTOR, outputCol="_axes").fit(vectors)
    loadings = model.pc.toArray()
    texts = []
    for axis in range(2):
        column = loadings[:, axis]
        column = column * np.sign(column[np.argmax(np.abs(column))])
        texts.append(
            " + ".join(
                f"{number_sql(float(weight))} * {z}" for weight, z in zip(column, scaled_names(features))
            )
        )
    return texts, [float(share) for share in model.explainedVariance]


# ---------------------------------------------------------------- whole operator


def cluster_table(
    df: DataFrame,
    features: list[str] = S.CLUSTER_FEATURES,
    sweep_restarts: int = 30,
    final_restarts: int = 40,
    seed: int = 42,
    metric: str = "squared",
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Rows with cluster and axes, the metric document, and the fitted pipeline.

    ``df`` should be a stored table, it is read for every fit.
    """
    raw, _ = scaled_vectors(df, features, log=False)
    raw = materialize(raw, "raw_vectors")
    vectors, scaler = scaled_vectors(df, features, log=True)
    vectors = materialize(vectors, "log_vectors")

    def sweep(rows: DataFrame) -> DataFrame:
        return evaluate_k(rows, features, sweep_restarts, seed, metric)

    # Passes over few points cost little but their start, so both sweeps run side by side.
    raw_rows, log_rows = in_parallel(df.sparkSession, sweep, [raw, vectors])
    k = choose_k(log_rows)
    best = fit_kmeans(vectors, k, final_restarts, seed, features)
    axes, shares = fit_axes(vectors, features)
    finish = SQLTransformer(
        statement=f"SELECT *, {relabel_sql(canonical_labels(best))} AS {CLUSTER}, "
        + ", ".join(f"{text} AS {name}" for text, name in zip(axes, AXES))
        + " FROM __THIS__"
    )
    model = PipelineModel([scaler, best.transformer(scaled_names(features)), finish])
    clustered = apply_clusters(model, df)
    metrics = cluster_metrics(clustered, log_rows, raw_rows, k, shares, features)
    return clustered, metrics, model


def apply_clusters(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, CLUSTER, *AXES)


def cluster_profile(clustered: DataFrame, features: list[str] = S.CLUSTER_FEATURES) -> DataFrame:
    return clustered.groupBy(CLUSTER).agg(
        F.expr("count(*) as taille"),
        *[F.expr(f"{round_sql(f'avg({c})', 2)} as {c}") for c in features],
    )


def compare_transformations(raw_rows: DataFrame, log_rows: DataFrame) -> DataFrame:
    return raw_rows.withColumn("transformation", F.lit("brut")).unionByName(
        log_rows.withColumn("transformation", F.lit("log1p"))
    )


def cluster_metrics(
    clustered: DataFrame,
    log_rows: DataFrame,
    raw_rows: DataFrame,
    k: int,
    shares: list[float],
    features: list[str],
) -> DataFrame:
    """One-row metric document."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        """Rows in order of their first column; maps have no order and follow the rest."""
        order = [n for n, kind in rows.dtypes if not kind.startswith("map")]
        keyed = F.struct(F.struct(*order).alias("order"), F.struct(*rows.columns).alias("row"))
        ranked = F.array_sort(
            F.collect_list(keyed),
            lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0),
        )
        return rows.agg(F.transform(ranked, lambda x: x["row"]).alias(name))

    profile = cluster_profile(clustered.where(F.col(CLUSTER).isNotNull()), features)
    parts = [
        log_rows.where(F.col("k") == k).select(
            F.col("k").alias("meilleur_k"), F.col("silhouette").alias("score_silhouette")
        ),
        listed(raw_rows, "diagnostic_brut"),
        listed(log_rows, "diagnostic_log1p"),
        listed(profile, "profils"),
        profile.agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col(CLUSTER).cast("string"), "taille")))
            ).alias("taille_clusters")
        ),
    ]
    shares_sql = "array(" + ", ".join(number_sql(share) for share in shares) + ")"
    return one_row(parts).withColumns(
        {
            "transformation": F.lit("log1p + StandardScaler"),
            "variance_pca_expliquee": F.expr(shares_sql),
        }
    )
