"""Sorts, limits, ranks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.workspace import written


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Ranks from 1 over the whole table, with a range-partitioned sort and one offset for each partition.

    No task sees all rows, unlike with a window that has no partitioning. ``order`` must be total. The sorted rows are written
    once and both places and sizes are read from there: a second run of the sort need not cut the rows alike.
    """
    part, place = "__part", "__place"
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place))
    rows = written(rows, "ranked")
    sizes = rows.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), part).withColumn(name, (F.col(place) + F.col("__before") + 1).cast("long")).drop(part, place, "__before")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key with their place; Spark keeps n rows a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def library_order(date: str = "date", filename: str = "filename") -> list[Column]:
    """Undated rows last, then latest first, then by name."""
    return [F.when(F.col(date) == "", 1).otherwise(0).asc(), F.col(date).desc(), F.col(filename).asc()]


def between_rows(ranked: DataFrame, key: str, one, other) -> DataFrame:
    """Rows from one to another, both included; nothing if neither is there."""
    ends = ranked.where(F.col(key).isin(one, other)).agg(F.min("rank").alias("__a"), F.max("rank").alias("__b"))
    return ranked.crossJoin(F.broadcast(ends)).where(F.col("rank").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def limit_with_total(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows, each with how many more there are."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("total") - n, F.lit(0)))


def greedy_nms(boxes: DataFrame, group: str, most: float = 0.4) -> DataFrame:
    """Of each group's boxes (x, y, w, h, score, id), by falling score, those that overlap no kept one by an IoU over ``most``.

    One shuffle gathers a group's rows in an array, which is folded in order: rows without a score come last, equal scores by id; a box with an unknown side
    overlaps nothing. A group is one image's detections, which a detector bounds; many small groups cost no more than few large ones.
    """
    side = lambda box: [F.coalesce(box["row"][c].cast("double"), F.lit(float("nan"))) for c in "xywh"]
    over = lambda one, box: F.nanvl(geo.iou(*side(one), *side(box)), F.lit(0.0)) > most
    none = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    rank = F.struct(none("score").alias("a"), F.when(~none("score"), -F.col("score")).alias("b"), F.col("id").isNull().alias("c"), F.col("id").alias("d"), F.struct(*boxes.columns).alias("row"))
    sets = boxes.select(F.col(group).alias("__group"), rank.alias("__r")).groupBy("__group").agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    kept = F.aggregate("__r", F.slice("__r", 1, 0), lambda held, box: F.when(F.exists(held, lambda one: over(one, box)), held).otherwise(F.concat(held, F.array(box))))
    return sets.select(F.explode(kept).alias("__k")).select("__k.row.*")


def best_overlap(boxes: DataFrame, known: DataFrame, image: list[str], key: str, other: str, sides: tuple[str, ...], least: float) -> DataFrame:
    """(key, other, overlap): for each box the known box of the same image with the most overlap over the smaller of both, above ``least``; equal ones to the smaller number.

    Equal boxes of an image are met once, known ones by their smallest number, and the answer goes to all boxes of the class by an equi join: pairs grow with the
    different boxes of an image, not with its copies. Boxes without a match are left out; null images match nothing.
    """
    mine, theirs = [*image, *sides[:4]], [*image, *sides[4:]]
    classes = known.groupBy(*theirs).agg(F.min(other).alias(other))
    pairs = boxes.select(*mine).distinct().join(classes, image).select(*mine, other, geo.overlap(*[F.col(c) for c in sides]).alias("__o")).where(F.col("__o") > least)
    best = pairs.groupBy(*mine).agg(F.max_by(other, F.struct(F.round("__o", 6), -F.col(other))).alias(other), F.max(F.round("__o", 6)).alias("overlap"))
    told = boxes.join(best, mine)  # a key may stand at several boxes
    return told.groupBy(key).agg(F.max_by(other, F.struct("overlap", -F.col(other))).alias(other), F.max("overlap").alias("overlap"))
