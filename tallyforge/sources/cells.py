"""Activity cells derived from an order fact table.

The fact rows are summed per (period, part) before the part attributes are joined, so the
second join moves cells instead of fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.runtime import materialize
from tallyforge.schema import CATEGORY, LABEL, MEASURES, PERIOD

PERIODS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001-S1"]
PERIOD_FACTORS = {"2001-S1": 2.0}
ORDINAL = "ordinal"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Contribution of one order line to each of the 14 measures, in measure order.
CONTRIBUTIONS = dict(
    zip(
        MEASURES,
        [
            "cast(o_orderpriority = '1-URGENT' as bigint)",
            "cast(o_orderpriority = '2-HIGH' as bigint)",
            "cast(o_orderpriority = '3-MEDIUM' as bigint)",
            "cast(o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') as bigint)",
            "if(l_returnflag = 'A', cast(l_quantity as bigint), 0L)",
            "if(l_returnflag = 'R', cast(l_quantity as bigint), 0L)",
            "if(l_returnflag = 'N' and l_linestatus = 'F', cast(l_quantity as bigint), 0L)",
            "if(l_returnflag = 'N' and l_linestatus = 'O', cast(l_quantity as bigint), 0L)",
            "cast(l_discount >= 0.08D as bigint)",
            "cast(l_tax >= 0.06D as bigint)",
            "cast(o_orderstatus = 'F' as bigint)",
            "cast(o_orderstatus = 'O' as bigint)",
            "cast(o_orderstatus = 'P' as bigint)",
            "cast(datediff(l_shipdate, o_orderdate) > 90 as bigint)",
        ],
    )
)


def fact_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per order line with its period and the 14 measure contributions.

    ``lines`` are the order lines with more columns, of which ``keep`` are kept.
    """
    lines = read(spark, sf_dir, "lineitem") if lines is None else lines
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        f"if(year(o_orderdate) = 2001, '2001-S1', cast(year(o_orderdate) as string)) as {PERIOD}",
        "l_partkey",
        "l_quantity",
        "year(o_orderdate) as order_year",
        *keep,
        *[f"{value} as {name}" for name, value in CONTRIBUTIONS.items()],
    )


def sums(columns: list[str]) -> list[Column]:
    return [F.expr(f"sum({name}) as {name}") for name in columns]


def fine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per (period, part): grows with the facts."""
    summed = fact_rows(spark, sf_dir).groupBy(PERIOD, "l_partkey").agg(*sums(MEASURES))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return summed.join(part, summed.l_partkey == part.p_partkey).selectExpr(
        PERIOD,
        f"p_type as {CATEGORY}",
        f"p_name as {LABEL}",
        *MEASURES,
        f"p_partkey as {ORDINAL}",
    )


def coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per (period, type, name)."""
    return (
        fine_cells(spark, sf_dir)
        .groupBy(PERIOD, CATEGORY, LABEL)
        .agg(*sums(MEASURES))
        .selectExpr("*", f"0L as {ORDINAL}")
    )


def _left_out() -> Column:
    """Small late lines, which the official totals lack, so later periods disagree."""
    return (F.col("l_quantity") < 2) & (F.col("order_year") >= 1999)


def official_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-period totals that leave out small late lines, so later periods disagree."""
    return (
        fact_rows(spark, sf_dir)
        .where(~_left_out())
        .groupBy(PERIOD)
        .agg(*sums(MEASURES))
    )


def coarse_and_official(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`coarse_cells` and :func:`official_totals` from one reading of the facts, whose sums are stored.

    Lines meet their part before their order, as long as they are narrow, and are then summed at once: no
    sums per part are shuffled. The parts are stored, so that the lines of a part that has very many can
    be split over tasks. A part that is listed twice counts twice in the cells, but once in the totals.
    """
    listed = read(spark, sf_dir, "part").where("p_partkey is not null")
    order = Window.partitionBy("p_partkey").orderBy("p_type", "p_name")
    parts = materialize(
        listed.select(
            "p_partkey", F.col("p_type").alias(CATEGORY), F.col("p_name").alias(LABEL), (F.row_number().over(order) == 1).alias("_first")
        ),
        "parts",
    )
    lines = read(spark, sf_dir, "lineitem")
    named = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    facts = fact_rows(spark, sf_dir, named, (CATEGORY, LABEL, "_first"))
    counted = F.coalesce(~_left_out(), F.lit(False)).alias("_counted")
    summed = materialize(facts.groupBy(PERIOD, CATEGORY, LABEL, "_first", counted).agg(*sums(MEASURES)), "coarse_sums")
    coarse = summed.where("_first is not null").groupBy(PERIOD, CATEGORY, LABEL).agg(*sums(MEASURES))
    official = summed.where("_counted and coalesce(_first, true)").groupBy(PERIOD).agg(*sums(MEASURES))
    return coarse.selectExpr("*", f"0L as {ORDINAL}"), official
