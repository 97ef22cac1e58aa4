"""Typed tables: Parquet between stages and the serving table in the catalog."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.runtime import exists, materialize


class StageMissing(FileNotFoundError):
    """A stage was asked to run, or a result to be read, before it was prepared."""


def read_prepared(spark: SparkSession, path: str, message: str) -> DataFrame:
    """A stored stage; only its absence is a :class:`StageMissing`, other errors pass."""
    if not exists(spark, path):
        raise StageMissing(f"{message} ({path})")
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet sink; partitioned output is clustered first so each folder gets few files.

    ``rebalance`` lets adaptive execution split a partition value that holds a large
    share of the rows over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def load_serving_table(
    df: DataFrame, table: str, force: bool = False, path: str | None = None, partition_by: str | None = "annee"
) -> int:
    """Fill a catalog table; a filled one stays untouched unless forced. Returns its size.

    ``path`` places the files outside the warehouse folder. The table is partitioned by the
    column that the served queries filter on, where it has it, so a filter reads one folder.
    A forced load of a table of the same columns and place swaps only the partitions that
    differ, see :func:`swap_partitions`; any other is made anew.
    """
    spark = df.sparkSession
    filled = spark.catalog.tableExists(table) and not spark.table(table).isEmpty()
    if not filled or (force and not _same_shape(df, table, path, partition_by)):
        placed = {"path": path} if path else {}
        if partition_by in df.columns:
            placed["partitionBy"] = partition_by
            df = df.hint("rebalance", partition_by)
        df.write.mode("overwrite").saveAsTable(table, **placed)
    elif force:
        swap_partitions(df, table, partition_by)
    return spark.table(table).count()


def swap_partitions(df: DataFrame, table: str, column: str) -> dict[str, list]:
    """Make a filled table equal to ``df`` by swapping the partitions of ``column`` that differ.

    Partitions are compared by their row counts and sums of row hashes, so the order of rows
    does not matter. Changed and new ones are written beside the table and renamed into it
    once all are complete; a load that fails on the way leaves every row as it was. Partitions
    that ``df`` no longer has go last, so readers never find the table empty unless ``df`` is.
    A reader that lists the folders during the renames can miss a partition for that moment.
    Returns the values written and removed; the null partition is the value None.
    """
    spark = df.sparkSession
    current = spark.table(table)
    rows = materialize(df.select(*current.columns), "load")
    both = _marks(rows, column, "new").join(
        _marks(current, column, "old"), F.col("_new").eqNullSafe(F.col("_old")), "full_outer"
    )
    differ = both.where("new is null or old is null or new <> old").collect()
    written = [row["_new"] for row in differ if row["new"] is not None]
    removed = [row["_old"] for row in differ if row["new"] is None]
    # The files are named before anything is written, so nothing written now is removed.
    gone = current.where(_is_one_of(column, removed)).inputFiles() if removed else []
    if written:
        fresh = rows.where(_is_one_of(column, written)).hint("rebalance", column)
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            fresh.write.insertInto(table, overwrite=True)
    for folder in {file.rsplit("/", 1)[0] for file in gone}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.catalog.refreshTable(table)
    return {"written": written, "removed": removed}


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for one write; the session has its own back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _marks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row per partition value: its row count and sum of row hashes, as ``name``."""
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
    grouped = rows.groupBy(F.col(f"`{column}`").alias(f"_{name}"))
    return grouped.agg(F.concat_ws(":", F.count("*"), F.sum(mark)).alias(name))


def _is_one_of(column: str, values: list) -> Column:
    known = F.col(f"`{column}`").isin([v for v in values if v is not None])
    return known | F.col(f"`{column}`").isNull() if None in values else known


def _same_shape(df: DataFrame, table: str, path: str | None, partition_by: str | None) -> bool:
    """Whether the table has the columns of ``df``, is partitioned alike and lies at ``path``."""
    spark = df.sparkSession
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if partition_by not in df.columns or parts != [partition_by]:
        return False
    if dict(spark.table(table).dtypes) != dict(df.dtypes):
        return False
    if path is None:
        return True
    described = spark.sql(f"describe table extended {table}").where("col_name = 'Location'").first()
    # A table's place is stated as a URI, a given path may lack its scheme.
    return described.data_type.rstrip("/").removeprefix("file:") == path.rstrip("/").removeprefix("file:")
