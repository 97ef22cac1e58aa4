"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.runtime import scratch_path

# Arrow batches of whole texts hold about this much; a longer text has a batch of its own.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch for operators that send whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Shuffle files go when the driver's references do, so the driver is asked to collect them
    before each stage; else the disk would hold the shuffles of all stages at once.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    release(spark)  # what the stage before has shuffled: its caller has let go of it by now
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    stored._stage_path = path
    return stored


def discard(*stages: DataFrame) -> None:
    """Delete stages that no later frame reads."""
    for stored in stages:
        remove(stored.sparkSession, stored._stage_path)


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a finished round through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def text_bytes(column: pa.Array) -> pa.Array:
    """A string column as large binary, null texts as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together; a longer text is alone."""
    start = size = 0
    lengths = pa.compute.binary_length(texts).to_pylist()
    for i, length in enumerate(lengths):
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(lengths):
        yield start, len(lengths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_column: str, folds: int):
    """The remainder of crc32 over the id as text, the folds of the labelled operators."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))
