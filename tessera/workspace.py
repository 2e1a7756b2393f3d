"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # by application: a setting of a running session cannot be changed


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, with the scheme of Hadoop's default file system where it names none, so that all readers of a path agree.

    Where it is unset, a temporary folder of one machine; a cluster must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        root = _own[app]
    if "://" not in root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut of the lineage that outlives executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the table of a frame that ``written`` gave, once what was made of it is written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None and path.toString().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark)).toString()):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as the session shuffles to or has cores for: a small file is else one task, however much is made of a row."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism))
