"""K-Means for many restarts and many k at once, over weighted distinct points.

All fits share their passes. One draw by k-means|| (Bahmani et al., 2012) gives candidates
whose number does not grow with the table; every restart takes its own seeds from them. A Lloyd
pass then scans the points once for all fits still moving: a task holds the centres of all of
them and returns one row of sums per centre. Fits that have come to the same centres
go on as one, and only the best of each k is carried on until nothing moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.numbers import number_sql
from tallyforge.runtime import materialize

WEIGHT = "_weight"
RAW_LABEL = "_label"
DRAWS = 3  # rounds of the seed draw
DRAWN = 128  # expected candidates of a round
STILL = 1e-7  # of the scaled features
ROWS = 1024  # points whose distances are held at once


@dataclass(frozen=True)
class Centres:
    """One fit: its centres, the weights and sums of their points, and the within-cluster cost."""

    centres: np.ndarray
    sizes: np.ndarray
    squares: np.ndarray
    cost: float
    moved: float = np.inf

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  named like the library's model
        return list(self.centres)

    def transformer(self, columns: list[str], label: str = RAW_LABEL) -> SQLTransformer:
        """Adds the number of the nearest centre, the first of several as near."""
        near = [
            " + ".join(f"pow({c} - {number_sql(float(x))}, 2)" for c, x in zip(columns, centre, strict=True))
            for centre in self.centres
        ]
        pairs = ", ".join(f"struct({distance} as d, {i} as i)" for i, distance in enumerate(near))
        return SQLTransformer(statement=f"SELECT *, array_min(array({pairs})).i AS {label} FROM __THIS__")


def distinct_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each different point once with its number of rows, stored.

    Passes cost far more than their bytes, so the points are dealt to all shuffle partitions,
    unless they are so few that starting a task takes longer than its share of a pass.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-df.count() // ROWS)))
    points = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(WEIGHT))
    return materialize(points.repartition(parts, *columns), "points")


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            part = batch.slice(low, ROWS)
            yield _matrix(part, columns), part.column(WEIGHT).to_numpy(zero_copy_only=False).astype(np.float64)


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by differences, which keeps exact ties exact."""
    out = np.zeros((len(points), len(centres)))
    for axis in range(points.shape[1]):
        out += (points[:, axis, None] - centres[None, :, axis]) ** 2
    return out


# ---------------------------------------------------------------- seeds


def _draw(points: DataFrame, columns: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate seeds and the weight of the points nearest to each.

    A point is drawn when a hash of it is below a multiple of its cost, so a draw repeats on any
    partitioning. The driver holds the candidates alone, about ``DRAWS * DRAWN`` of them.
    """
    keyed = points.withColumn("_draw", F.xxhash64(F.lit(seed), *columns))
    first = keyed.agg(F.min_by(F.struct(*columns), F.struct("_draw", *columns))).first()[0]
    found = np.array([list(first)], np.float64)
    for turn in range(DRAWS):
        total = _weigh(points, columns, found)[1]
        if total <= 0:
            break
        uniform = points.withColumn(
            "_uniform", F.pmod(F.xxhash64(F.lit(seed + 1 + turn), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))
        )
        near = found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _matrix(batch, columns)
                cost = np.concatenate([_squared(own[i : i + ROWS], near).min(1) for i in range(0, len(own), ROWS)] or [np.zeros(0)])
                chance = DRAWN * batch.column(WEIGHT).to_numpy(zero_copy_only=False) * cost / total
                hit = np.flatnonzero(batch.column("_uniform").to_numpy(zero_copy_only=False) < chance)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit)) for c in columns], columns)

        drawn = uniform.mapInArrow(run, ", ".join(f"{c} double" for c in columns)).toArrow()
        if len(drawn):
            found = np.unique(np.vstack([found, *(_matrix(b, columns) for b in drawn.to_batches())]), axis=0)
    return found, _weigh(points, columns, found)[0]


def _weigh(points: DataFrame, columns: list[str], candidates: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of the points nearest to each candidate, and their whole cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, costs = np.zeros(len(candidates)), np.zeros(len(candidates))
        for own, weight in _chunks(batches, columns):
            square = _squared(own, candidates)
            nearest = square.argmin(1)
            weights += np.bincount(nearest, weight, len(candidates))
            costs += np.bincount(nearest, weight * square.min(1), len(candidates))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(candidates))), pa.array(weights), pa.array(costs)], ["i", "w", "c"]
        )

    sums = points.mapInArrow(run, "i long, w double, c double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    weights, total = np.zeros(len(candidates)), 0.0
    for row in sums.collect():
        weights[row.i], total = row.w, total + row.c
    return weights, total


def _seeds(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over the candidates (Arthur and Vassilvitskii, 2007)."""
    chosen = [rng.choice(len(candidates), p=weights / weights.sum())]
    while len(chosen) < k:
        cost = weights * _squared(candidates, candidates[chosen]).min(1)
        if cost.sum() <= 0:
            chosen.append(chosen[0])
        else:
            chosen.append(rng.choice(len(candidates), p=cost / cost.sum()))
    return candidates[chosen]


# ---------------------------------------------------------------- Lloyd


def _nearest(own: np.ndarray, centres: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` fits and each point the first nearest of ``k`` centres, and its distance less the point's square."""
    sides = np.column_stack([-2 * centres, (centres * centres).sum(1)]), np.vstack([own.T, np.ones(len(own))])
    distance = (sides[0] @ sides[1]).reshape(n, k, len(own))
    least, nearest = distance[:, 0].copy(), np.zeros((n, len(own)), np.int8 if k < 128 else np.int64)
    for i in range(1, k):
        np.copyto(nearest, i, where=distance[:, i] < least)
        np.minimum(least, distance[:, i], out=least)
    return nearest, least


def _pass(points: DataFrame, columns: list[str], fits: list[Centres]) -> list[Centres]:
    """One pass for all fits; each comes back with its moved centres and what belongs to the old ones."""
    by_k: dict[int, list[int]] = {}
    for number, fit in enumerate(fits):
        by_k.setdefault(len(fit.centres), []).append(number)
    groups = [(k, np.concatenate([fits[i].centres for i in own])) for k, own in by_k.items()]
    total = sum(len(fit.centres) for fit in fits)
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 3, total))
        for own, weight in _chunks(batches, columns):
            square = (own * own).sum(1)
            values = np.vstack([weight, weight * own.T, weight * square])
            at = 0
            for k, centres in groups:
                n = len(centres) // k
                nearest, least = _nearest(own, centres, n, k)
                # A fit's cost is told by its first centre alone.
                sums[-1, at : at + n * k : k] += np.maximum(least + square, 0.0) @ weight
                for i in range(k):
                    # A product of matrices adds up all fits' points with this label.
                    sums[:-1, at + i : at + n * k : k] += values @ (nearest == i).astype(np.float64).T
                at += n * k
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total)), *(pa.array(s) for s in sums)], ["i", *(f"s{j}" for j in range(width + 3))]
        )

    names = [f"s{j}" for j in range(width + 3)]
    partial = points.mapInArrow(run, ", ".join(["i long", *(f"{n} double" for n in names)]))
    rows = partial.groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).collect()
    sums = np.zeros((total, width + 3))
    for row in rows:
        sums[row.i] = row[1:]
    out: list[Centres | None] = [None] * len(fits)
    at = 0
    for k, own in by_k.items():
        for number in own:
            part, old = sums[at : at + k], fits[number].centres
            sizes = part[:, 0]
            fresh = np.where(sizes[:, None] > 0, part[:, 1:-2] / np.maximum(sizes, 1)[:, None], old)
            out[number] = Centres(fresh, sizes, part[:, -2], float(part[:, -1].sum()), float(np.abs(fresh - old).max()))
            at += k
    return out


def _merged(fits: dict) -> dict:
    """Fits of one k whose centres agree to six digits, in any order, go on as one."""
    seen, out = set(), {}
    for key, fit in fits.items():
        own = fit.centres[np.lexsort(fit.centres.T[::-1])].round(6) + 0.0
        mark = (len(own), own.tobytes())
        if mark not in seen:
            seen.add(mark)
            out[key] = fit
    return out


def fit_all(
    points: DataFrame, columns: list[str], ks: list[int], restarts: int, seed: int = 42,
    tolerance: float = 1e-2, most_passes: int = 300,
) -> dict[int, Centres]:
    """The best of ``restarts`` fits for each k over stored ``distinct_points``.

    Every restart moves until no centre moves by ``tolerance``; the best of each k then goes on
    until none moves by ``STILL``, within ``most_passes`` passes each. A centre without points stays
    where it is. No points give no fits.
    """
    if not ks or points.isEmpty():
        return {}
    candidates, weights = _draw(points, columns, seed)
    none = np.zeros(0)
    moving = {
        (k, turn): Centres(_seeds(candidates, weights, k, np.random.default_rng([seed, k, turn])), none, none, np.inf)
        for k in ks
        for turn in range(restarts)
    }
    still: dict = {}
    for _ in range(most_passes):
        moving = _merged(moving)
        moving = dict(zip(moving, _pass(points, columns, list(moving.values())), strict=True))
        still |= {key: fit for key, fit in moving.items() if fit.moved <= tolerance}
        moving = {key: fit for key, fit in moving.items() if fit.moved > tolerance}
        if not moving:
            break
    every = still | moving
    best = {k: min((f for key, f in every.items() if key[0] == k), key=lambda f: f.cost) for k in ks}
    for _ in range(most_passes):
        loose = [k for k, fit in best.items() if fit.moved > STILL]
        if not loose:
            break
        best |= dict(zip(loose, _pass(points, columns, [best[k] for k in loose]), strict=True))
    # The sizes, squares and cost of the centres as they now are.
    last = _pass(points, columns, list(best.values()))
    return {k: replace(new, centres=old.centres) for (k, old), new in zip(best.items(), last, strict=True)}


def silhouettes(points: DataFrame, columns: list[str], fits: dict[int, Centres]) -> dict[int, float]:
    """Mean silhouette with squared distances of each fit, all in one pass.

    The mean squared distance from a point to a cluster follows from the cluster's size, sum and
    sum of squares, so a pass is linear. A point alone in its cluster counts 0.
    """
    means = {}
    for k, fit in fits.items():
        used = fit.sizes > 0
        means[k] = (fit.centres, used, fit.sizes, np.where(used, fit.squares / np.maximum(fit.sizes, 1), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(means, 0.0)
        for own, weight in _chunks(batches, columns):
            square = (own * own).sum(1)
            for k, (centres, used, sizes, squares) in means.items():
                label = _squared(own, centres).argmin(1)
                mean = np.maximum(square[:, None] + squares[None, :] - 2 * own @ centres.T, 0.0)
                rows, size = np.arange(len(own)), sizes[label]
                inner = mean[rows, label] * size / np.maximum(size - 1, 1)
                mean[rows, label] = np.inf
                outer = np.where(used[None, :], mean, np.inf).min(1)
                larger = np.maximum(inner, outer)
                width = np.where((size > 1) & (larger > 0), (outer - inner) / np.where(larger > 0, larger, 1), 0.0)
                sums[k] += float((width * weight).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()))], ["k", "w"])

    found = points.mapInArrow(run, "k long, w double").groupBy("k").agg(F.sum("w").alias("w")).collect()
    return {row.k: row.w / float(fits[row.k].sizes.sum()) for row in found}
