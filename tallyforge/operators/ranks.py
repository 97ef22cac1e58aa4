"""Average ranks and rank correlation without sorting rows.

A row's rank depends only on its value, so values are counted first and only distinct
values are ordered. That way a value shared by a third of all rows is one counted row and
never a group of rows in one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tallyforge.functions.numbers import round_half_even, round_sql
from tallyforge.operators.quantiles import Extent, extents
from tallyforge.operators.reshape import long_rows
from tallyforge.runtime import materialize
from tallyforge.schema import PROFILE_MEASURES

BROADCAST_VALUES = 100_000
HOT_VALUES = 1_000
SALTS = 1_024
ARRAY_RANGE = 4_096
ROW = "_row"


def _value_ranks(counts: DataFrame) -> DataFrame:
    """Average rank of each distinct value from running counts within ranges of values.

    Spark cuts the distinct values into as many ranges as it has shuffle partitions, so no
    window grows with a variable; only the ranges' sums are ordered among each other.
    """
    ranged = materialize(
        counts.repartitionByRange("variable", "value").withColumn("part", F.spark_partition_id()),
        "value_ranges",
    )
    within = Window.partitionBy("variable", "part").orderBy("value")
    earlier = Window.partitionBy("variable").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("variable", "part")
        .agg(F.sum("n").alias("n"))
        .select("variable", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    running = ranged.withColumn("upto", F.sum("n").over(within))
    rank = F.col("before") + F.col("upto") - (F.col("n") - 1) / 2
    return running.join(offsets, ["variable", "part"]).select("variable", "value", "n", rank.alias("rank"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its average rank. ``df`` should be a stored table.

    Whole numbers in a small range look their rank up by position in a literal array,
    columns with few distinct values by broadcast join, all others by shuffle join.
    """
    known = extents(df, columns)
    df = df.selectExpr(*[f"cast({c} as double) as {c}" for c in columns]).dropna()
    counts = materialize(
        long_rows(df, [], [{"variable": f"'{c}'", "value": c} for c in columns])
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n")),
        "value_counts",
    )
    sizes = {
        row.variable: row.n
        for row in counts.groupBy("variable").agg(F.count("*").alias("n")).collect()
    }
    ranks = materialize(_value_ranks(counts), "value_ranks")
    by_position = [
        c for c in columns if known[c].count and known[c].whole and known[c].high - known[c].low <= ARRAY_RANGE
    ]
    lookups = _position_lookups(ranks, by_position, known)
    total = df.count()
    if any(c not in lookups and sizes.get(c, 0) > BROADCAST_VALUES for c in columns):
        # A stored number per row spreads hot rows, whatever they hold.
        df = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered_rows")
    for c in columns:
        found = ranks.where(F.col("variable") == c).select(
            F.col("value").alias(c), F.col("rank").alias(f"rank_{c}"), "n"
        )
        if c in lookups:
            continue
        if sizes.get(c, 0) <= BROADCAST_VALUES:
            df = df.join(F.broadcast(found.drop("n")), c, "left")
        else:
            df = _join_many_values(df, found, c, total)
    return df.selectExpr(*[f"{lookups.get(c, f'rank_{c}')} as {c}" for c in columns])


def _position_lookups(
    ranks: DataFrame, columns: list[str], known: dict[str, Extent]
) -> dict[str, str]:
    """SQL text per column that reads the rank of ``value - low`` from an array."""
    arrays = {c: ["0"] * (known[c].high - known[c].low + 1) for c in columns}
    for row in ranks.where(F.col("variable").isin(columns)).collect():
        arrays[row.variable][int(row.value) - known[row.variable].low] = str(row.rank)
    return {
        c: f"get(cast(split('{','.join(values)}', ',') as array<double>), "
        f"cast({c} - {known[c].low} as int))"
        for c, values in arrays.items()
    }


def _join_many_values(df: DataFrame, found: DataFrame, c: str, total: int) -> DataFrame:
    """Rank lookup by shuffle, hot values served by broadcast.

    A value is hot above one row in ``HOT_VALUES``, so there are at most that many. Rows
    with a hot value get a random salt that matches nothing and spreads them out.
    """
    hot = found.where(F.col("n") * HOT_VALUES > total).select(
        c, F.col(f"rank_{c}").alias("hot_rank")
    )
    cold = found.drop("n").withColumn("salt", F.lit(0))
    spread = 1 + F.pmod(F.xxhash64(ROW), F.lit(SALTS)).cast("int")
    marked = df.join(F.broadcast(hot), c, "left").withColumn(
        "salt", F.when(F.col("hot_rank").isNull(), F.lit(0)).otherwise(spread)
    )
    return (
        marked.join(cold, [c, "salt"], "left")
        .withColumn(f"rank_{c}", F.coalesce("hot_rank", f"rank_{c}"))
        .drop("hot_rank", "salt")
    )


def _rank_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    ranked = average_ranks(df, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="ranks").transform(ranked)
    matrix = Correlation.corr(vectors.select("ranks"), "ranks", "pearson").first()[0].toArray()
    return {(a, b): float(matrix[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns)}


def spearman(df: DataFrame, columns: list[str] = PROFILE_MEASURES) -> DataFrame:
    """Rank correlation of every pair of columns, as (i, j, variable_1, variable_2, rho).

    A pair is ranked over the rows that have both values; NaN is a missing one. Columns
    without gaps share one ranking, and one that has gaps is ranked with all of them over its own
    rows, so only pairs of columns with gaps cost a ranking each. Without rows rho is NaN.
    """
    whole = {c: isinstance(df.schema[c].dataType, IntegralType) for c in columns}
    df = df.selectExpr(
        *[c if whole[c] else f"nanvl(cast({c} as double), cast(null as double)) as {c}" for c in columns]
    )
    pairs = list(combinations(columns, 2))
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count(c).alias(c) for c in columns],
    ).first()
    full = [c for c in columns if row[c] == row.rows]
    gaps = [c for c in columns if row[c] < row.rows]
    both = [p for p in pairs if p[0] in gaps and p[1] in gaps]
    shared = (
        df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(both)]).first()
        if both
        else ()
    )
    rho: dict[tuple[str, str], float] = {}
    groups = [(full, row.rows)] if full else []
    groups += [([c, *full], row[c]) for c in gaps]
    groups += [(list(p), n) for p, n in zip(both, shared, strict=True)]
    for group, rows in groups:
        if rows:
            found = _rank_matrix(df.select(*group).dropna(), group)
            rho.update({k: v for k, v in found.items() if k not in rho})
    rows = [
        (i, j, a, b, rho.get((a, b), float("nan")))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "i int, j int, variable_1 string, variable_2 string, rho double"
    )


def correlation_table(correlations: DataFrame) -> DataFrame:
    return correlations.select(
        "variable_1", "variable_2", round_half_even(F.nanvl("rho", F.lit(None).cast("double")), 6).alias("rho")
    )


def strongest_pairs(correlations: DataFrame, limit: int = 20) -> DataFrame:
    pairs = correlations.where((F.col("i") < F.col("j")) & ~F.isnan("rho"))
    return (
        pairs.withColumn("abs_rho", F.abs("rho"))
        .orderBy(F.col("abs_rho").desc(), "i", "j")
        .limit(limit)
        .select(
            "variable_1",
            "variable_2",
            F.expr(round_sql("rho", 3)).alias("rho"),
            round_half_even(F.col("abs_rho"), 3).alias("abs_rho"),
        )
    )
