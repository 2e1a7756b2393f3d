"""The upload queue: attempts, waits and restarts end as the rule of one worker does."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessera.streaming import uploads

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sender():
    def send(path, attempt):  # local, so that workers need not import the tests
        if path is None:
            return "no path"
        return None if attempt > int(path[1:]) else f"HTTP 500 {path}"

    return send


def one_worker(tasks):
    """A queue in order; a task that failed fewer than three times goes to its end."""
    queue, ended = [(k, path, 0) for k, path in tasks], {}
    while queue:
        k, path, failed = queue.pop(0)
        error = sender()(path, failed + 1)
        if error is None or failed + 1 == 3:
            ended[k] = (error is None, failed + 1, error)
        else:
            queue.append((k, path, failed + 1))
    return ended


def test_a_stopped_queue_goes_on_where_it_was(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tasks = spark.range(24).select("id", F.when(F.col("id") != 5, F.concat(F.lit("p"), F.col("id") % 4)).alias("path"))
        tasks.where("id < 16").write.parquet(f"{tmp_path}/in")

        def start(step):
            stream = spark.readStream.schema(tasks.schema).parquet(f"{tmp_path}/in")
            results = uploads.uploads(stream, sender(), step=step).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            return results.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()

        query, end = start(2.0), time.monotonic() + 60
        while (query.lastProgress is None or query.lastProgress["numInputRows"] == 0) and time.monotonic() < end and query.isActive:
            time.sleep(0.02)
        query.stop()
        out = lambda: spark.read.schema(uploads.RESULT).parquet(f"{tmp_path}/out").collect()
        half = {r.id for r in out()}
        assert {k for k in range(16) if k % 4 == 0} <= half and len(half) < 16  # some wait in the state
        tasks.where("id >= 16").write.mode("append").parquet(f"{tmp_path}/in")
        assert uploads.drained(start(2.0), 90)
        got = out()
        assert len(got) == 24  # each task ends once
        assert {r.id: (r.success, r.attempts, r.error) for r in got} == one_worker([tuple(r) for r in tasks.orderBy("id").collect()])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
