"""A uniform shuffle into shards by a hypergeometric communication matrix, in DataFrame functions alone.

Rows are dealt into blocks by a hash; the exact number of rows that each block sends to each shard is drawn
from the multivariate hypergeometric law, the law of these counts under a uniform random permutation. Each
block is permuted and cut by its row of the matrix, the pieces are exchanged, and each shard is permuted
again. Shard sizes are exact whatever the draw. Only block counts and the matrix pass the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import written


ROWS_A_GROUP = 250_000  # of a block, and of a piece of a shard: what one task sorts
BROADCAST_MOST = 100_000  # rows of a driver-made table, of at most 32 numbers each


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw. numpy's own up to its limit of 10**9; above, by inversion outwards from the mode."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    at = math.exp(log(good, mode) + log(bad, n - mode) - log(good + bad, n))
    u, down, up, pd, pu = rng.random() - at, mode, mode, at, at
    while u > 0 and (down > low or up < high):
        if up < high:
            pu *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each block to each shard; row and column sums are exact."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    matrix = []
    for rows in block_rows:
        sent, rest, need = [], sum(left), rows
        for s, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, need)
            sent.append(got)
            need -= got
            left[s] -= got
        matrix.append(sent)
    return matrix


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_MOST else df


def shard_uniformly(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text: str = "text", rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """One row per document: (id_col, size, text_crc32, law, shard, slot, grown_shard).

    size is the UTF-8 bytes of the text plus 1, null as none. The law is ``rows``: shard sizes differ by one
    at most, larger ones first. slot counts from 0 without gaps within a shard; the order is a uniform
    permutation that the seed and the ids fix. Rows that repeat an id stay rows of their own (ties fall by
    checksum and size; equal rows are interchangeable). An empty table gives an empty table. The text
    itself is not shuffled. grown_shard is null: adding a shard reshuffles all.
    """
    spark = docs.sparkSession
    raw = F.col(text).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("crc"))
    total = rows.count()
    n_blocks = max(64, -(-total // rows_a_group))
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_blocks)).cast("int")), "blocks")
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    blocks = sorted(counts)
    matrix = communication_matrix([counts[b] for b in blocks], [total // shards + (s < total % shards) for s in range(shards)], seed)
    ends = [(b, [int(x) for x in np.cumsum(sent)]) for b, sent in zip(blocks, matrix, strict=True)]
    bounds = spark.createDataFrame(ends, "block int, ends array<long>")

    local = Window.partitionBy("block").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "crc", "size")
    ranked = rows.withColumn("rank", F.row_number().over(local) - 1)
    sent = ranked.join(_small(bounds, len(ends)), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int"))
    bits = max(4, math.ceil(math.log2(max(1, total / shards / rows_a_group))))
    mark = F.xxhash64("id", F.lit(seed + 2))
    sent = written(sent.select("id", "size", "crc", "shard", mark.alias("mark")).withColumn("piece", F.shiftright("mark", 64 - bits).cast("int")), "sent")

    pieces = sent.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "piece").orderBy("mark", "id", "crc", "size")
    placed = sent.withColumn("inside", F.row_number().over(inside) - 1).join(_small(pieces, shards << bits), ["shard", "piece"])
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
