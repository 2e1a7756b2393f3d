"""Tables kept in order on disk: a page of ranks reads the parts that hold it, and sorts nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.workspace import partitions

PART, PLACE, BEFORE, SIZE = "__part", "__place", "__before", "__n"
PARTS = StructType([StructField(PART, IntegerType()), StructField(BEFORE, LongType()), StructField(SIZE, LongType())])


@dataclass(frozen=True)
class Ordered:
    """Rows in parts by order, and one row a part: how many rows come before it and how many it has."""

    rows: DataFrame
    parts: DataFrame


def write_in_order(df: DataFrame, order: list[Column | str], path: str, parts: int | None = None) -> Ordered:
    """Writes ``df`` under ``path`` in the total order ``order``, once for all pages.

    One shuffle by range cuts the rows into ``parts`` folders (as many as the session's shuffle partitions if not told), each sorted by its task. The
    list of parts has one row a folder; it is all that a page looks up. An empty table has no parts. Of rows that tie in ``order`` any may come first.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(parts or partitions(spark), *order).withColumn(PART, F.spark_partition_id())
    rows = cut.sortWithinPartitions(PART, *order).withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sizes = _rows(spark, path, df.schema).groupBy(PART).agg(F.count("*").alias(SIZE))
    sizes.select(PART, F.coalesce(F.sum(SIZE).over(before), F.lit(0)).alias(BEFORE), SIZE).write.mode("overwrite").parquet(f"{path}/parts")
    return opened(spark, path, df.schema)


def opened(spark: SparkSession, path: str, schema: StructType) -> Ordered:
    """A table that ``write_in_order`` left there; ``schema`` is that of its rows."""
    return Ordered(_rows(spark, path, schema), spark.read.schema(PARTS).parquet(f"{path}/parts"))


def page(table: Ordered, first: int, end: int, columns: int = 1, margin: int = 0) -> DataFrame:
    """Rows of ranks over ``first`` up to ``end`` with their rank, and ``margin`` grid rows of ``columns`` more on either side.

    The wanted parts are broadcast to a scan that is pruned by them while it runs: other folders are not opened. Ranks beyond the table give no rows.
    """
    low, high = first - margin * columns, end + margin * columns
    wanted = table.parts.where((F.col(BEFORE) < high) & (F.col(BEFORE) + F.col(SIZE) > low))
    ranked = table.rows.join(F.broadcast(wanted), PART).withColumn("rank", F.col(BEFORE) + F.col(PLACE) + 1)
    return ranked.where((F.col("rank") > low) & (F.col("rank") <= high)).drop(PART, PLACE, BEFORE, SIZE)


def total(table: Ordered) -> DataFrame:
    """One row: how many rows the table has, told from its list of parts."""
    return table.parts.agg(F.coalesce(F.sum(SIZE), F.lit(0)).alias("total"))


def more_rows(table: Ordered, seen: int, n: int) -> DataFrame:
    """The ``n`` rows behind the ``seen`` first ones, with their rank and how many are left after them."""
    return page(table, seen, seen + n).crossJoin(F.broadcast(total(table))).withColumn("remaining", F.greatest(F.col("total") - seen - n, F.lit(0))).drop("total")


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(PLACE, LongType()), StructField(PART, IntegerType())])).parquet(f"{path}/rows")
