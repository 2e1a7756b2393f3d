"""Shared folders: paths without a scheme, sessions without a setting, tables that are deleted."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tessera import workspace


def session(spark, root, master="local[2]"):
    context = SimpleNamespace(master=master, applicationId=f"app-{root}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)


def test_roots(spark):
    assert workspace.shared_root(session(spark, "/tmp/shared/")) == "file:///tmp/shared"
    assert workspace.shared_root(session(spark, "hdfs://host/x/")) == "hdfs://host/x"
    own = workspace.shared_root(session(spark, None))
    assert own.startswith("file:///") and workspace.shared_root(session(spark, None)) == own
    with pytest.raises(RuntimeError):
        workspace.shared_root(session(spark, "", "local-cluster[1,1,1024]"))


def test_removed(spark):
    df = workspace.written(spark.range(3), "x")
    other = workspace.written(spark.range(4), "y")
    workspace.removed(df)
    assert other.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    workspace.removed(spark.range(2))
