"""Committed versions of stored tables.

A version is a folder of its own; it counts once a small manifest beside it has been renamed
into place. The manifest names the version's schema, row count and fingerprint, and the
fingerprints of the tables it was made from, all taken while the version was written. A reader
never sees half a version, and can tell when an input has changed since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyforge.sources.tables import StageMissing

KEPT_VERSIONS = 2


class StageBroken(RuntimeError):
    """The files of a committed version are not those that its manifest names."""


class StageStale(RuntimeError):
    """An input of a stage has changed since the stage was written."""


@dataclass(frozen=True)
class Manifest:
    version: str
    rows: int
    fingerprint: str
    schema: str
    inputs: dict[str, str] = field(default_factory=dict)


def _file(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed manifests, oldest first."""
    system, folder = _file(spark, f"{path}/_manifests")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def _load(spark: SparkSession, path: str, number: int) -> Manifest:
    system, target = _file(spark, f"{path}/_manifests/{number}.json")
    stream = system.open(target)
    try:
        return Manifest(**json.loads(bytes(stream.readAllBytes())))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest that was committed last, or None."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else None


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    numbers = _numbers(spark, path)
    number = numbers[-1] + 1 if numbers else 1
    system, draft = _file(spark, f"{path}/_manifests/{manifest.version}.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()
    _, target = _file(spark, f"{path}/_manifests/{number}.json")
    if system.exists(target) or not system.rename(draft, target):
        raise StageBroken(f"another writer has committed version {number} of {path}")
    for old in numbers[: len(numbers) + 1 - KEPT_VERSIONS]:
        for name in (_load(spark, path, old).version, f"_manifests/{old}.json"):
            system.delete(_file(spark, f"{path}/{name}")[1], True)


def write_version(df: DataFrame, path: str, inputs: dict[str, str] | None = None) -> Manifest:
    """Write ``df`` as a new version of the table at ``path`` and commit it.

    ``inputs`` holds the fingerprints of what it was made from. Rows and fingerprint are
    observed during the write, so no second pass reads the table; the fingerprint does not
    depend on the order of rows. The version before is kept for those who still read it.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    seen = Observation()
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(row).alias("total"))
    watched.write.parquet(f"{path}/{version}")
    found = seen.get
    fingerprint = f"{found['rows']}:{found['total'] or 0}"
    manifest = Manifest(version, found["rows"], fingerprint, df.schema.simpleString(), inputs or {})
    _commit(spark, path, manifest)
    return manifest


def read_version(spark: SparkSession, path: str, message: str, inputs: dict[str, str] | None = None) -> DataFrame:
    """The committed version of the table at ``path``.

    Without one it is a :class:`StageMissing`. The files' rows and schema must be those of the
    manifest, and where ``inputs`` (fingerprints now) are given, those it was made from.
    """
    manifest = latest(spark, path)
    if manifest is None:
        raise StageMissing(f"{message} ({path})")
    for name, now in (inputs or {}).items():
        if manifest.inputs.get(name) != now:
            raise StageStale(f"{name} has changed since {path} was written; {message}")
    folder = f"{path}/{manifest.version}"
    system, target = _file(spark, folder)
    if not system.exists(target):
        raise StageBroken(f"the files of {folder} are gone")
    rows = spark.read.parquet(folder)
    if rows.schema.simpleString() != manifest.schema or rows.count() != manifest.rows:
        raise StageBroken(f"the files of {folder} differ from their manifest")
    return rows
