"""Incremental pipelines with Structured Streaming: each takes what is there and ends (trigger availableNow)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.streaming import snapshots
from tessera.workspace import new_folder


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream; a bounded number of files a batch is the back-pressure."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def run_to_end(stream: DataFrame, apply, spark: SparkSession, mode: str = "append", checkpoint: str | None = None) -> None:
    """Hands what is there to ``apply``, batch by batch; with a ``checkpoint`` of its own a later run goes on where this one ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint or new_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_per_user(spark: SparkSession, path: str, root: str | None = None, buckets: int = snapshots.BUCKETS, files_a_batch: int = 8) -> DataFrame:
    """(user_id, event_id, n): the latest event of each user and how many there were, upserted batch by batch.

    Each batch is pre-aggregated and merged into a bucketed snapshot: only the buckets of its users are written anew, and a batch that is run again
    after a failure changes nothing. With a ``root`` of its own, a later call takes only the files that came since.
    """
    root = root or new_folder(spark, "latest")
    schema = StructType.fromDDL("user_id long, last struct<ts:timestamp_ntz,event_id:long>, n long")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
        snapshots.merge_batch(batch.sparkSession, root, new, ["user_id"], [F.max("last").alias("last"), F.sum("n").alias("n")], number, buckets)

    run_to_end(file_stream(spark, path, files_a_batch), merge, spark, checkpoint=f"{root}/stream")
    return snapshots.snapshot(spark, root, schema).select("user_id", F.col("last.event_id").alias("event_id"), "n")


def first_seen(spark: SparkSession, path: str, keys: list[str], time: str | None = None, delay: str = "1 day", files_a_batch: int = 8) -> DataFrame:
    """Each combination of keys once, by the stream's own state.

    Without ``time`` the state holds every combination there has been, and a repeat is told however late it comes. With it a combination leaves
    the state at the end of the batch in which the stream's time has passed it by ``delay``: repeats within ``delay`` of the first are always told,
    those of batches after that one count as new.
    """
    target = new_folder(spark, "seen")
    rows = file_stream(spark, path, files_a_batch)
    if time is None:
        seen = rows.select(*keys).dropDuplicates(keys)
    else:
        own = rows.select(*keys, F.col(time).cast("timestamp").alias("__time"))
        seen = own.withWatermark("__time", delay).dropDuplicatesWithinWatermark(keys).select(*keys)
    query = seen.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(seen.schema).parquet(target)


def retry(failed: Column, attempts: Column, most: int = 3, step: int = 5) -> tuple[Column, Column]:
    """(status, seconds to wait): a failure is tried again while under ``most`` attempts, after a wait linear in them."""
    again = failed & (attempts < most)
    status = F.when(~failed, "done").when(again, "retry").otherwise("failed")
    return status, F.when(again, step * attempts).otherwise(0)


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The first row of each key that is not done yet; the work of a repeated run is nothing."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key]))).where("__r = 1").drop("__r")
    return first.join(done.select(key), key, "left_anti")
