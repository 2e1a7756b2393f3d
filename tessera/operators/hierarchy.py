"""Folder and collection trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.workspace import written


def ancestors(path: Column | str) -> Column:
    """All proper and improper folder prefixes of a path, shortest first: /a/b gives /a, /a/b."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def rollup_folders(counts: DataFrame, path: str, n: str) -> DataFrame:
    """(path, own, total, depth) of every folder that is listed or above a listed one; one shuffle by path."""
    own = counts.select(F.explode(ancestors(path)).alias("a"), F.col(path).alias("__p"), F.col(n).alias("__n"))
    return own.groupBy("a").agg(
        F.sum(F.when(F.col("a") == F.col("__p"), F.col("__n")).otherwise(0)).alias("own"), F.sum("__n").alias("total")
    ).select(F.col("a").alias("path"), "own", "total", (F.size(F.split("a", "/")) - 1).alias("depth"))


def nearest_ancestor(folders: DataFrame, path: str) -> DataFrame:
    """(path, parent): the longest listed folder above each one, null for roots; an equi join on prefixes, no nested loop."""
    listed = folders.select(F.col(path).alias("path")).distinct()
    above = listed.select("path", F.explode(ancestors("path")).alias("a")).where("a <> path")
    best = above.join(listed.select(F.col("path").alias("a")), "a").groupBy("path").agg(F.max_by("a", F.length("a")).alias("parent"))
    return listed.join(best, "path", "left")


def with_levels(nodes: DataFrame, key: str, parent: str, most: int = 10) -> DataFrame:
    """(key, level, trail) of the nodes that reach a root (parent null) in at most ``most`` steps.

    Deeper nodes, orphans and nodes of a cycle are dropped: ``most`` bounds the passes. Each level that there is
    reads the nodes once, joins them with the level above, which is written, and ends the loop where nothing is below. A key that repeats counts
    as often, as does all below it.
    """
    known = nodes.select(key, parent)
    level = known.where(F.col(parent).isNull()).select(F.col(key), F.lit(1).alias("level"), F.array(F.col(key).cast("string")).alias("trail"))
    levels = [written(level, "level")]
    while len(levels) < most and not levels[-1].isEmpty():
        up = levels[-1].select(F.col(key).alias("__up"), "trail")
        below = known.join(up, F.col(parent) == F.col("__up")).select(F.col(key), F.lit(len(levels) + 1).alias("level"), F.concat("trail", F.array(F.col(key).cast("string"))).alias("trail"))
        levels.append(written(below, "level"))
    return reduce(DataFrame.union, levels)
