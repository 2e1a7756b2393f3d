"""Exact dedup by content-defined chunk recipes.

Each text, white space deleted, is cut where a rolling hash of the last bytes has a given form, so equal
runs of bytes are cut alike wherever they stand. Chunks are deduplicated to identifiers (their number in a
written dictionary), each verified by length, 64-bit hash and SHA-256 of its bytes. A document is then
the ordered list of its identifiers, and only these short lists are shuffled and compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import written

from .rows import TAGS, row_tags, rows_of
from .textkit import blocks, byte_values, span_hashes

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WINDOW, LEAST, MOST, MEAN_BITS = 32, 512, 16384, 11
_GEAR = (byte_values(7) >> np.uint64(32)).astype(np.uint32)

CUT_SCHEMA = f"id long, {TAGS[0]} long, {TAGS[1]} long, chars long, sha string, pos array<int>, fast array<long>, len array<int>, strong array<binary>"


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the hash of the last ``WINDOW`` bytes has its top bits zero."""
    h = _GEAR[data]
    factor = 0x01000193
    k = 1
    while k < WINDOW:
        nxt = h.copy()
        nxt[k:] += h[:-k] * np.uint32(factor)
        h, factor, k = nxt, factor * factor & 0xFFFFFFFF, 2 * k
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(cuts: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from begin to end; every chunk but the last has LEAST to MOST bytes."""
    ends = []
    at = begin
    while end - at > LEAST:
        i = bisect_left(cuts, at + LEAST)
        nxt = min(cuts[i] if i < len(cuts) else end, at + MOST, end)
        ends.append(nxt)
        at = nxt
    if at < end:
        ends.append(end)
    return ends


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            keep = ~SPACE[data]
            sums = np.concatenate([[0], np.cumsum(keep)])
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            own, at = data[keep], sums[offsets]
            cuts = cut_points(own)
            begins, stops, per, shas = [], [], [], []
            raw = memoryview(np.ascontiguousarray(own))
            for i in range(len(part)):
                a, b = int(at[i]), int(at[i + 1])
                lo, hi = np.searchsorted(cuts, (a, b), side="right")
                ends = chunk_ends(cuts[lo:hi].tolist(), a, b)
                begins += [a, *ends[:-1]] if ends else []
                stops += ends
                per.append(len(ends))
                shas.append(hashlib.sha256(raw[a:b]).hexdigest())
            fast = span_hashes(own, np.array(begins, dtype=np.int64), np.array(stops, dtype=np.int64)).astype(np.int64)
            strong = pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(begins, stops, strict=True)], pa.binary())
            edges = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            pos = np.arange(len(begins), dtype=np.int32) - np.repeat(edges[:-1], per).astype(np.int32)
            lens = np.array(stops, dtype=np.int32) - np.array(begins, dtype=np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(edges), values)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", *TAGS)), pa.array(np.diff(heads[offsets]), pa.int64()), pa.array(shas), lists(pa.array(pos)), lists(pa.array(fast)), lists(pa.array(lens)), lists(strong)],
                names=["id", *TAGS, "chars", "sha", "pos", "fast", "len", "strong"],
            )


def _decided(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, row, TAGS, keep_id, group_size, kept, sha) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *row_tags(id_col, text), F.col(text).alias("text"))
    # the row numbers are made once, in what is written; each later step finds back to a row by its number, whatever its id
    rows = written(texts.mapInArrow(_cut, CUT_SCHEMA).withColumn("row", F.monotonically_increasing_id()), "chunks")
    chunks = rows.select("row", F.explode(F.arrays_zip("pos", "fast", "len", "strong")).alias("c")).select("row", "c.pos", "c.fast", "c.len", "c.strong")
    # The tables that copies are joined with are written apart: so Spark can split the rows of a frequent chunk or text over tasks.
    known = written(chunks.select("fast", "len", "strong").distinct().withColumn("chunk", F.monotonically_increasing_id()), "dictionary")
    named = chunks.join(known, ["fast", "len", "strong"]).select("row", "pos", "chunk")
    recipes = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("r"))
    recipes = recipes.select("row", F.transform("r", lambda x: x["chunk"]).alias("recipe"))
    about = rows.select("row", "id", *TAGS, "chars", "sha")
    listed = about.join(recipes, "row", "left")
    listed = written(listed.withColumn("recipe", F.coalesce("recipe", F.array().cast(dict(recipes.dtypes)["recipe"]))), "recipes")
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("no_id"), "id", *TAGS, "row")
    groups = written(listed.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
    out = listed.join(groups, "recipe")
    return out.select("id", "row", *TAGS, F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after deleting ASCII white space (0x09-0x0D, 0x20); null counts as
    empty, and empty texts are equal to each other. Of equal texts the one with the most code points in
    the original stays, then the smallest id, a null id last. Exactly one row of a group is kept, also where rows repeat an id; rows
    that repeat id and text are interchangeable. keep_id is null where the row that stays has no id. An empty table gives
    an empty table. Other columns are not read.
    """
    out = _decided(docs, id_col, text)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all columns whatever their names: one of each group, null ids among them."""
    return rows_of(docs, _decided(docs, id_col, text).where("kept"), id_col, text)
