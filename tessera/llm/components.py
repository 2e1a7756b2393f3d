"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import written


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and all its v."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u")  # least is a table of its own, so that Spark can split the pairs of a hub


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that it reaches.

    Edges may repeat, point either way, or join a node to itself; none gives an empty table. Each
    round is written to the shared folder, so lost executors cost one round at most. The rounds needed
    grow with the logarithm of the longest chain; not converging in ``most_rounds`` raises.
    """
    now = written(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "edges")
    before = _fingerprint(now)
    if before[0]:
        for _ in range(most_rounds):
            both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = _lowest(large)
            small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            now = written(small, "edges")
            after = _fingerprint(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
