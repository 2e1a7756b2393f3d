"""Snapshots of keyed rows in buckets: a batch writes anew only the buckets that its keys fall into.

Under a root there are ``rows/version=<batch>/__bucket=<bucket>`` and ``manifest/<batch>``. A manifest names for each bucket the version that holds it, so
it has at most as many rows as there are buckets. A version counts once its manifest has been renamed into place; what a batch that failed before that has left is
overwritten by its next run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.workspace import new_folder, removed, written

BUCKET = "__bucket"
BUCKETS = 64  # of a size that one task writes; fixed for the life of a root
HELD = StructType([StructField("bucket", IntegerType()), StructField("version", LongType())])


def merge_batch(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], combine: list[Column], number: int, buckets: int = BUCKETS) -> list[int]:
    """Merges ``batch`` into the snapshot as version ``number`` and returns the buckets written.

    ``combine`` gives the other columns from rows of the snapshot and of the batch alike (a maximum, a sum of counts). Pre-aggregate the batch by key; hot
    keys then are one row each, and buckets are even. A batch whose number is not above the last version has been merged and changes nothing. Null keys are keys as any.
    """
    last, held = manifest(spark, root)
    if number <= last:
        return []
    new = written(batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "batch")
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets``
    old = _read(spark, root, {b: held[b] for b in touched if b in held}, batch.schema)
    both = old.unionByName(new).repartition(BUCKET).groupBy(BUCKET, *keys).agg(*combine)
    both.select(BUCKET, *batch.columns).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/rows/version={number}")
    removed(new)
    _commit(spark, root, number, held | dict.fromkeys(touched, number))
    return touched


def snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows of the last version; none if there is no version yet."""
    return _read(spark, root, manifest(spark, root)[1], schema).drop(BUCKET)


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, int]]:
    """The number of the last version and, for each bucket, the version that holds it; (-1, {}) before the first."""
    found = _numbers(spark, f"{root}/manifest")
    if not found:
        return -1, {}
    return max(found), {r.bucket: r.version for r in spark.read.schema(HELD).json(f"{root}/manifest/{max(found)}").collect()}


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all manifests but the last ``keep`` and the buckets that none of these names; returns how many buckets went."""
    if keep < 1:
        raise ValueError("the last version stays")
    numbers = sorted(_numbers(spark, f"{root}/manifest"))
    live = {(r.version, r.bucket) for n in numbers[-keep:] for r in spark.read.schema(HELD).json(f"{root}/manifest/{n}").collect()}
    gone = 0
    for n in numbers[:-keep]:
        _delete(spark, f"{root}/manifest/{n}")
    for version in _numbers(spark, f"{root}/rows", "version="):
        for bucket in _numbers(spark, f"{root}/rows/version={version}", f"{BUCKET}="):
            if version <= max(numbers, default=-1) and (version, bucket) not in live:
                gone += _delete(spark, f"{root}/rows/version={version}/{BUCKET}={bucket}")
    return gone


def _read(spark: SparkSession, root: str, held: dict[int, int], schema: StructType) -> DataFrame:
    schema = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    if not held:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/rows/version={v}/{BUCKET}={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths).select(*schema.names)


def _commit(spark: SparkSession, root: str, number: int, held: dict[int, int]) -> None:
    draft = new_folder(spark, "manifest")
    spark.createDataFrame(sorted(held.items()), HELD).coalesce(1).write.json(draft)
    there = _path(spark, f"{root}/manifest/{number}")
    files = _files(spark, there)
    files.mkdirs(there.getParent())
    if not files.rename(_path(spark, draft), there):
        raise OSError(f"version {number} of {root} was not put in place")


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    path = _path(spark, folder)
    files = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return _files(spark, path).delete(path, True)
