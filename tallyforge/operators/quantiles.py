"""Exact order statistics and linear-interpolated quantiles with bounded state.

Built-in ``percentile`` keeps every distinct value of a column in one task. It is used
where the value range of a whole-number column proves that state small. Elsewhere the
wanted ranks are narrowed down by equal-width histograms: each pass counts the values of
the remaining intervals per bin, and the bin that holds a rank, tightened to the smallest
and largest value seen in it, becomes the next interval. A pass moves at most
``BINS`` rows per open interval, whatever the data size or skew, and ends when an
interval holds a single value.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

BINS = 1024
INFINITY = float("inf")
SMALL_RANGE = 65_536


@dataclass(frozen=True)
class Extent:
    """Present values, the smallest and largest finite ones, and the infinite ones at both ends."""

    count: int
    low: float | int | None
    high: float | int | None
    whole: bool
    below: int = 0
    above: int = 0


def _value(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def extents(df: DataFrame, columns: list[str]) -> dict[str, Extent]:
    """Count, smallest and largest present value of each column, in one pass."""
    aggregates = []
    for i, column in enumerate(columns):
        value = _value(df, column)
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.min(_finite(df, column)).alias(f"lo{i}"),
            F.max(_finite(df, column)).alias(f"hi{i}"),
            F.count_if(value == -INFINITY).alias(f"below{i}"),
            F.count_if(value == INFINITY).alias(f"above{i}"),
        ]
    row = df.agg(*aggregates).first()
    return {
        column: Extent(
            row[f"n{i}"],
            row[f"lo{i}"],
            row[f"hi{i}"],
            isinstance(df.schema[column].dataType, T.IntegralType),
            row[f"below{i}"],
            row[f"above{i}"],
        )
        for i, column in enumerate(columns)
    }


def _finite(df: DataFrame, column: str) -> Column:
    value = _value(df, column)
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return value
    return F.when(F.abs(value) < INFINITY, value)


def _place(value: Column, low: float | int, high: float | int) -> Column:
    """Part of the way from ``low`` to ``high``; halves keep wide ranges within a double."""
    if isinstance(low, int) and high - low < 2**62:
        return (value - F.lit(low)).cast("double") / F.lit(float(high - low))
    low, high, value = float(low), float(high), value.cast("double")
    if math.isinf(high - low):
        low, high, value = low / 2, high / 2, value / 2
    return (value - F.lit(low)) / F.lit(high - low)


def _histogram(df: DataFrame, intervals: list[tuple]) -> dict[int, list]:
    entries = []
    for slot, (column, low, high) in enumerate(intervals):
        value = _value(df, column)
        place = F.floor(_place(value, low, high) * F.lit(float(BINS)))
        bin_number = F.least(place, F.lit(BINS - 1)).cast("int")
        entry = F.struct(
            F.lit(slot).alias("slot"), bin_number.alias("bin"), value.alias("value")
        )
        entries.append(F.when(value.between(low, high), entry))
    bins = (
        df.select(F.explode(F.array(*entries)).alias("entry"))
        .where(F.col("entry").isNotNull())
        .groupBy("entry.slot", "entry.bin")
        .agg(
            F.count("*").alias("n"),
            F.min("entry.value").alias("low"),
            F.max("entry.value").alias("high"),
        )
    )
    found = defaultdict(list)
    for row in bins.collect():
        found[row.slot].append((row.bin, row.n, row.low, row.high))
    return {slot: sorted(rows) for slot, rows in found.items()}


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], known: dict[str, Extent] | None = None
) -> dict[str, dict[int, float | int]]:
    """Exact values at the given 0-based ranks of each column.

    ``df`` is scanned a few times; pass a stored table. Whole-number and floating columns
    are narrowed in separate passes so that long keys keep all their digits.
    """
    known = known or extents(df, list(ranks))
    answers: dict[str, dict] = {column: {} for column in ranks}
    for whole in (True, False):
        pending = []
        for column, wanted in ranks.items():
            own = known[column]
            if own.whole is not whole or not own.count:
                continue
            inside = own.count - own.above
            answers[column].update({rank: -math.inf for rank in wanted if rank < own.below})
            answers[column].update({rank: math.inf for rank in wanted if rank >= inside})
            middle = sorted({rank for rank in wanted if own.below <= rank < inside})
            if middle:
                pending.append((column, own.low, own.high, own.below, middle))
        while pending:
            still_open = []
            for column, low, high, below, wanted in pending:
                if low == high:
                    answers[column].update({rank: low for rank in wanted})
                else:
                    still_open.append((column, low, high, below, wanted))
            pending = []
            if not still_open:
                break
            found = _histogram(df, [(c, low, high) for c, low, high, _, _ in still_open])
            for slot, (column, lowest, highest, below, wanted) in enumerate(still_open):
                for _, size, low, high in found[slot]:
                    inside = [rank for rank in wanted if below <= rank < below + size]
                    if inside:
                        if (low, high) == (lowest, highest):
                            raise ArithmeticError(f"no progress between {low} and {high} in {column}")
                        pending.append((column, low, high, below, inside))
                    below += size
    return answers


def _between(low: float, high: float, part: float) -> float:
    """Linear interpolation; between equal neighbours, infinite ones too, the neighbour."""
    if low == high or part == 0:
        return low
    return low + (high - low) * part if math.isfinite(high - low) else low * (1 - part) + high * part


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring ranks, nulls left out."""
    known = extents(df, columns)
    quantiles: dict[str, list[float | None]] = {}
    small = [
        c for c in columns
        if known[c].count and known[c].whole and known[c].high - known[c].low <= SMALL_RANGE
    ]
    if small:
        row = df.agg(
            *[
                F.percentile(c, F.array(*[F.lit(p) for p in probabilities])).alias(f"q{i}")
                for i, c in enumerate(small)
            ]
        ).first()
        quantiles.update({c: list(row[f"q{i}"]) for i, c in enumerate(small)})
    positions = {
        c: [p * (known[c].count - 1) for p in probabilities]
        for c in columns
        if known[c].count and c not in small
    }
    wanted = {
        c: [rank for at in places for rank in (math.floor(at), math.ceil(at))]
        for c, places in positions.items()
    }
    values = order_statistics(df, wanted, known) if wanted else {}
    for column, places in positions.items():
        at_rank = values[column]
        quantiles[column] = [
            _between(float(at_rank[math.floor(at)]), float(at_rank[math.ceil(at)]), at - math.floor(at))
            for at in places
        ]
    empty: list[float | None] = [None] * len(probabilities)
    return {column: quantiles.get(column, empty) for column in columns}
