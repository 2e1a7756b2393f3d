"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. A census over blocks of n-gram columns counts, over all texts, in how many each n-gram occurs. It gives a
   table of small counts by hash and a list of the columns that many texts hold.
2. A row whose shared columns are too few for any partner is dropped: a link needs ``percent`` of a row's
   own size. Of each other row only the columns that a partner of sufficient overlap cannot all miss are
   kept, the first ``n - ceil(t n) + 1`` in the order unshared, then from rarer to more frequent. A column's place
   in this order bounds the overlap still to come, and so the size of a partner met there first (``reach``): a row leaves
   a column all of whose rows are larger.
3. Texts with equal n-gram sets are one row of the matrix (a class). Blocks of columns are multiplied:
   members of a column are first held against one pivot row, the least odd one, whose columns the
   most texts hold (of many near copies, their origin), then, where a column still holds rows of
   several components, all rows of different components are, with overlap counts accumulated over columns
   and pairs dropped that cannot reach the size-derived bound.
4. What is left is verified on whole sets; links give components.

A column is unshared if no text but the copies of its own class holds it. The table has a fixed size and the list
a fixed bound: beyond them more candidates are held against each other, but too high a count and any order of
columns leave the links as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import partitions, written

from .components import components
from .rows import TAGS, row_tags, rows_of
from .textkit import U64, blocks, folded, sequence_hash, span_hashes, spans, window_hashes, byte_values

WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
_VALUES = byte_values(1)[folded()]
HEAVY_MOST = 1_000_000  # frequent columns, the most frequent first: 8 MB is the most that is broadcast
COUNTS_HELD = 1 << 25  # of the table of small counts, 4 bits each: 16 MB, broadcast
SMALL_MOST = 15
NO_ID = 1 << 62  # numbers from here on stand for classes of rows without an id
UNLISTED = 1 << 40  # stands for the count of a column in more texts than the table can tell that was cut from the list
CENSUS_ROWS = 4 << 20


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its sorted distinct n-gram hashes). Fewer words than ``width``: the whole sequence is one."""
    row = 0
    for part, data, offsets in blocks(batch, column):
        starts, ends, first = spans(data, offsets, WORD)
        words = span_hashes(data, starts, ends, _VALUES)
        grams = window_hashes(words, width)
        for i in range(len(part)):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield row + i, np.unique(grams[a : b - width + 1])
            elif b > a:
                yield row + i, np.array([sequence_hash(words[a:b])], dtype=U64)
            else:
                yield row + i, np.empty(0, dtype=U64)
        row += len(part)


def _packed(low: np.ndarray) -> bytes:
    steps = np.diff(low, prepend=low.dtype.type(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)


def column_id(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    """Block of columns above, 32 bits of the hash below."""
    return ((grams % U64(n_blocks)) << U64(32)) | (grams >> U64(32))


def census(docs: DataFrame, text: str, width: int, n_blocks: int) -> DataFrame:
    """(block, small, often, counts) over all texts: the block's part of the table, and its columns in more than ``SMALL_MOST`` texts with their counts."""
    held_most = max(2, COUNTS_HELD // n_blocks // 2 * 2)
    most = max(1, HEAVY_MOST // n_blocks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ids.sort()
            block = (ids >> U64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(ids))
            return pa.RecordBatch.from_pydict({"block": pa.array(block[cuts], pa.int64()), "grams": pa.array([_packed(ids[a:b].astype(np.uint32)) for a, b in zip(cuts, ends, strict=True)], pa.binary())})

        for batch in batches:
            for _, grams in shingle_sets(batch, text, width):
                if len(grams):
                    held.append(column_id(grams, n_blocks))
                    n += len(grams)
                if n >= CENSUS_ROWS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        low = np.concatenate([_unpacked(x.as_py()) for x in table.column("grams")])
        low.sort()
        cuts = np.flatnonzero(np.diff(low, prepend=U64(1 << 40)))
        runs = np.diff(np.append(cuts, len(low)))
        small = np.zeros(held_most, dtype=np.uint8)
        for c in range(2, SMALL_MOST + 1):  # the larger count stays where columns meet
            small[low[cuts[runs >= c if c == SMALL_MOST else runs == c]] % U64(held_most)] = c
        many = np.flatnonzero(runs > SMALL_MOST)
        many = many[np.argsort(-runs[many], kind="stable")[:most]]
        often = (low[cuts[many]] | U64(block << 32)).astype(np.int64)
        return pa.table({
            "block": pa.array([block], pa.int64()), "small": pa.array([(small[::2] << 4 | small[1::2]).tobytes()], pa.binary()),
            "often": pa.array([often], pa.list_(pa.int64())), "counts": pa.array([runs[many]], pa.list_(pa.int64())),
        })

    counted = docs.select(text).mapInArrow(emit, "block long, grams binary")
    return counted.groupBy("block").applyInArrow(count, "block long, small binary, often array<long>, counts array<long>")


class Columns:
    """What the census tells of columns, in a form to broadcast."""

    def __init__(self, rows: list, n_blocks: int):
        self.n_blocks = n_blocks
        self.held = max(2, COUNTS_HELD // n_blocks // 2 * 2)
        self.small = np.zeros((n_blocks, self.held // 2), dtype=np.uint8)
        for r in rows:
            self.small[r["block"]] = np.frombuffer(r["small"], dtype=np.uint8)
        self.cut = np.zeros(n_blocks, dtype=bool)  # blocks whose list may lack columns
        for r in rows:
            self.cut[r["block"]] = len(r["often"]) >= max(1, HEAVY_MOST // n_blocks)
        often = np.concatenate([np.array(r["often"], dtype=np.int64) for r in rows] or [np.empty(0, dtype=np.int64)]).astype(U64)
        order = np.argsort(often)
        self.often = often[order]
        self.counts = np.concatenate([np.array(r["counts"], dtype=np.int64) for r in rows] or [np.empty(0, dtype=np.int64)])[order]

    def count(self, grams: np.ndarray) -> np.ndarray:
        """In how many texts each column is, or more: 1 to ``SMALL_MOST``; above that the count, or ``UNLISTED`` where the list may lack it."""
        ids = column_id(grams, self.n_blocks)
        place = ids % U64(1 << 32) % U64(self.held)
        block = (ids >> U64(32)).astype(np.int64)
        byte = self.small[block, (place >> U64(1)).astype(np.int64)]
        n = np.maximum(np.where(place & U64(1), byte & 15, byte >> 4), 1).astype(np.int64)
        n[(n == SMALL_MOST) & self.cut[block]] = UNLISTED
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, ids), len(self.often) - 1)
            hit = self.often[at] == ids
            n[hit] = self.counts[at[hit]]
        return n


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int64) if values else np.empty(0, dtype=np.int64)))


def signatures(docs: DataFrame, text: str, width: int, percent: int, columns: Broadcast) -> DataFrame:
    """(id, TAGS, n, set_key, grams): size and digest of the n-gram set, and the set itself where enough of it is in other texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, wholes = [], [], []
            for _, grams in shingle_sets(batch, text, width):
                n.append(len(grams))
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                in_others = np.count_nonzero(columns.value.count(grams) > 1)
                wholes.append(grams if in_others and in_others * 100 >= percent * len(grams) else grams[:0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *TAGS)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(wholes)], names=["id", *TAGS, "n", "set_key", "grams"])

    return docs.select("id", *TAGS, text).mapInArrow(sign, f"id long, {TAGS[0]} long, {TAGS[1]} long, n long, set_key binary, grams array<long>")


def prefixes(sets: DataFrame, percent: int, columns: Broadcast) -> DataFrame:
    """(id, n, alone, odd, prefix, grams) of classes (id, copies, grams) that may have a partner; alone counts the unshared columns, odd is the mean of 1 / texts over all columns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, alones, oddness, firsts, wholes = [], [], [], [], [], []
            for i in range(batch.num_rows):
                grams = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(U64)
                count = columns.value.count(grams)
                others = np.maximum(count - batch.column(1)[i].as_py(), 0)
                rank = np.where(count > SMALL_MOST, SMALL_MOST + np.log2(count).astype(np.int64), count)
                rank[count == UNLISTED] = SMALL_MOST  # those cut are the rarest of the frequent
                rank[others == 0] = 0
                alone = int(np.count_nonzero(rank == 0))
                if (len(grams) - alone) * 100 >= percent * len(grams):
                    left = len(grams) - (percent * len(grams) + 99) // 100 + 1 - alone
                    ids.append(batch.column(0)[i].as_py())
                    n.append(len(grams))
                    alones.append(alone)
                    oddness.append(float(np.mean(1 / (1 + others))))
                    firsts.append(grams[np.argsort(rank, kind="stable")[alone : alone + left]])
                    wholes.append(grams)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(alones, pa.int64()), pa.array(oddness, pa.float64()), _lists(firsts), _lists(wholes)], names=["id", "n", "alone", "odd", "prefix", "grams"])

    return sets.select("id", "copies", "grams").mapInArrow(cut, "id long, n long, alone long, odd double, prefix array<long>, grams array<long>")


def _reach(percent: int):
    """The largest partner whose first common column is this one: the columns from ``place`` on must be able to make ``percent`` of the union."""
    return F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent + F.lit(1e-9)).cast("long") - F.col("n")


def _sizes_fit(a: str, reach_a: str, b: str, reach_b: str):
    return (F.col(a) <= F.col(reach_b)) & (F.col(b) <= F.col(reach_a))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select("a", "b", (F.size("ga") + F.size("gb")).cast("long").alias("total"), F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    return shared.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def _joined(docs: DataFrame, id_col: str, text: str, width: int, percent: int, star_rounds: int = 1) -> DataFrame:
    """(id, TAGS, n, component) of every row; a component of rows without an id has a number from ``NO_ID`` on, an empty set none."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), *row_tags(id_col, text), F.col(text).alias("text"))
    about = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("id").alias("top")).first()
    if about["top"] is not None and about["top"] >= NO_ID:
        raise ValueError(f"ids must be below {NO_ID}")
    n_blocks = max(partitions(spark), int((about["bytes"] or 0) >> 26), 1)
    counted = census(docs, "text", width, n_blocks).collect()  # COUNTS_HELD and HEAVY_MOST bound it
    columns = spark.sparkContext.broadcast(Columns(counted, n_blocks))
    signed = written(signatures(docs, "text", width, percent, columns), "signed")

    without = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_key"), 2)  # stands for the ids of a class that has none
    least = F.coalesce(F.min("id"), F.first(without))
    classes = written(signed.where("n > 0").groupBy("set_key").agg(least.alias("rep")), "classes")
    active = signed.where(F.size("grams") > 0).groupBy("set_key").agg(least.alias("id"), F.count("*").alias("copies"), F.first("grams").alias("grams"))  # equal in all copies
    sets = written(prefixes(active, percent, columns), "sets")
    whole = Window.partitionBy("h")
    met = sets.select(F.posexplode("prefix").alias("place", "h"), "id", "n", "alone", "odd").withColumn("place", (F.col("place") + F.col("alone")).cast("int")).withColumn("reach", _reach(percent))
    met = met.withColumn("least", F.min("n").over(whole)).withColumn("most", F.max("reach").over(whole)).where("reach >= least and n <= most").drop("least", "most")
    met = met.withColumn("pivot", F.min(F.struct("odd", "id", "n", "reach")).over(whole)).withColumn("rows", F.count("*").over(whole)).where("rows > 1")
    met = written(met.select("h", "id", "n", "place", "reach", "odd", F.col("pivot.id").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.reach").alias("pr")), "met")
    sets = sets.select("id", "grams")

    pairs = met.where((F.col("id") != F.col("p")) & _sizes_fit("n", "reach", "pn", "pr")).select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    links = written(_links(pairs, sets, percent), "links")
    parts = components(links)

    for turn in range(1, star_rounds + 2):
        placed = met.select("h", "id", "n", "place", "reach", "odd").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = placed.withColumn("low", F.min("component").over(whole)).withColumn("high", F.max("component").over(whole)).where("low < high").drop("low", "high")
        placed = written(placed, "placed")
        per = placed.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left = per.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum("s").alias("rows")).first()
        if not left["pairs"]:
            break
        last = turn > star_rounds or left["pairs"] <= max(50_000, 4 * left["rows"])
        if last:
            one, two = placed.alias("x"), placed.alias("y")
            cross = one.join(two, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _sizes_fit("x.n", "x.reach", "y.n", "y.reach"))
            counted = cross.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("met"), F.max("x.place").alias("pa"), F.max("y.place").alias("pb"))
            to_come = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
            pairs = counted.where((F.col("met") + to_come) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")
        else:
            pick = F.min_by(F.struct("id", "n", "reach", "component"), F.struct(F.xxhash64(F.lit(turn), "component"), "odd", "id")).over(whole)
            star = placed.withColumn("p", pick).where((F.col("component") != F.col("p.component")) & _sizes_fit("n", "reach", "p.n", "p.reach"))
            pairs = star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        links = links.union(written(_links(pairs, sets, percent), "links"))
        parts = components(links)
        if last:
            break

    # the few classes are written with their component, so that Spark can split the rows of a text with many copies
    of_class = written(classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "of_class")
    full = signed.where("n > 0").select("id", *TAGS, "n", "set_key").join(of_class, "set_key").select("id", *TAGS, "n", "component")
    return full.unionByName(signed.where("n = 0").select("id", *TAGS, "n", F.lit(None).cast("long").alias("component")))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id).

    Words are the runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its
    distinct ``width``-word n-grams. Two documents link when 100 |A & B| >= percent |A | B|; component_id
    is the least id reachable by links, null ids aside (null if there is no other). Null, empty and wordless texts have an empty
    set and are linked with nothing. Each row counts with its own text, whether its id is null or repeated; an empty table gives
    an empty table. Other columns are not read.
    """
    found = _joined(docs, id_col, text, width, percent)
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("component") < NO_ID, F.col("component"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns whatever their names: that with the smallest id, a null id last. Rows with an empty set
    all stay, but those that repeat id and text once."""
    found = _joined(docs, id_col, text, width, percent)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", *TAGS)
    first = found.where("n > 0").groupBy("component").agg(F.min(order).alias("first")).select(*[F.col(f"first.{t}").alias(t) for t in TAGS])
    return rows_of(docs, first.unionByName(found.where("n = 0").select(*TAGS)), id_col, text)
