"""Bucketed snapshots: bytes written follow the batch, repeated and broken batches change nothing."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.streaming import incremental, snapshots

SCHEMA = "k long, v long"


def total():
    return [F.sum("v").alias("v")]


def files(folder) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, root):
    return {r.k: r.v for r in snapshots.snapshot(spark, root, frame(spark, []).schema).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert held(spark, root) == {} and snapshots.manifest(spark, root) == (-1, {})
    assert len(snapshots.merge_batch(spark, root, frame(spark, [(k, 1) for k in range(500)]), ["k"], total(), 0, buckets=16)) == 16
    before = files(tmp_path)
    touched = snapshots.merge_batch(spark, root, frame(spark, [(7, 10), (7, 1), (900, 5), (None, 3)]), ["k"], total(), 1, buckets=16)
    new = set(files(tmp_path)) - set(before)
    assert len(touched) == len(new) <= 3 and all(files(tmp_path)[f] == t for f, t in before.items())
    want = {k: 1 for k in range(500)} | {7: 12, 900: 5, None: 3}
    assert held(spark, root) == want
    for number in (1, 0):  # handed over again
        assert snapshots.merge_batch(spark, root, frame(spark, [(7, 10)]), ["k"], total(), number, buckets=16) == []
    assert held(spark, root) == want and set(files(tmp_path)) == set(before) | new
    assert snapshots.merge_batch(spark, root, frame(spark, []), ["k"], total(), 2, buckets=16) == [] and held(spark, root) == want
    assert snapshots.expire(spark, root, keep=3) == 0
    assert snapshots.expire(spark, root, keep=1) == len({b for b in touched}) and held(spark, root) == want
    with pytest.raises(ValueError):
        snapshots.expire(spark, root, keep=0)


def test_a_batch_that_failed_before_its_manifest(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    snapshots.merge_batch(spark, root, frame(spark, [(1, 1), (2, 2)]), ["k"], total(), 0, buckets=4)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_commit", lost)
        with pytest.raises(OSError):
            snapshots.merge_batch(spark, root, frame(spark, [(1, 100), (3, 3)]), ["k"], total(), 1, buckets=4)
    assert held(spark, root) == {1: 1, 2: 2}
    snapshots.merge_batch(spark, root, frame(spark, [(1, 10), (3, 3)]), ["k"], total(), 1, buckets=4)
    assert held(spark, root) == {1: 11, 2: 2, 3: 3}


def test_a_stream_takes_up_where_it_ended(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(6).cache()
    path, root = f"{tmp_path}/events", f"file://{tmp_path}/root"
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
        got = {tuple(r) for r in incremental.latest_per_user(spark, path, root, buckets=8, files_a_batch=2).collect()}
        so_far = events.where(F.col("event_id") % 2 <= half).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")), F.count("*"))
        assert got == {tuple(r) for r in so_far.collect()}
