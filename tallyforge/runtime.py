"""Shared scratch folder and stage materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets one private folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tallyforge-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_scratch(spark)}/{uuid.uuid4().hex}/{name}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tallyforge/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every stage that this application has stored.

    For when a result has been written: frames that still read a stage break.
    """
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage once as Parquet in the shared folder and read it back.

    Later passes scan only the columns they need, and a lost executor costs a re-read
    rather than a recomputation of the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parallel(spark: SparkSession, work: Callable, items: Iterable, threads: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads; results keep their order."""
    with ThreadPoolExecutor(threads) as pool:
        # Each job is wrapped on its own: a wrapper carries one set of local properties.
        jobs = [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]
        return [job.result() for job in jobs]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of Hadoop's file system."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


class RollingState:
    """Keeps the state of an iterative job in two alternating shared folders.

    The state being read is never the one being replaced, so disk use stays at two
    copies however many iterations run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._base = scratch_path(spark, name)
        self._turn = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self._base}/{self._turn % 2}"
        self._turn += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
