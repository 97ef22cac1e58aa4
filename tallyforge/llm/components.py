"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import remove
from tallyforge.runtime import scratch_path


def _state(edges: DataFrame) -> tuple:
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), sums).first())


def _round(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, over edges with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    large = (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not its component's least.

    Each round contracts towards least neighbours; degrees of hot nodes are reduced by a
    map-side minimum, and the joins back to them can be split by adaptive execution. Rounds
    go to the shared folder and the one before is deleted. Null ends and loops are ignored;
    no edges give an empty result.
    """
    spark = edges.sparkSession
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    current = edges.where("a <> b").select(*ends).distinct()
    schema, before, seen = None, None, None
    while True:
        path = scratch_path(spark, "stars")
        current.write.parquet(path)
        schema = schema or current.schema
        current = spark.read.schema(schema).parquet(path)
        state = _state(current)
        if before:
            remove(spark, before)
        if state == seen or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, seen = path, state
        current = _round(current)
