"""Vector code compression: product codes whose codebooks are found by Lloyd's rounds over heaps.

Vectors are packed in blocks of rows. For each part position and entry a block holds a heap of the parts assigned to the entry, keyed by
slack: the lower bound of the distance to any other entry less the distance to this one, plus what the entry's drift had summed up to when the part was
put there. Each round adds to an entry's drift how far it moved and how far the farthest-moved other entry did. While the least key
exceeds the sum, no bound of the heap can be violated and nothing is looked at; parts below it are popped, measured against all entries exactly, and
put into the heap of their nearest. Only parts that change their entry move its sum.

A round reads the blocks of the one before and writes its own, so that lost executors cost one round; older ones are removed. The driver
holds the codebooks and their sums, of 4 times ``ENTRIES`` entries.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.workspace import removed, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 4096
LARGEST = 1 << 27  # of a component: beyond, a squared error might not fit a long
STATE = "ids array<long>, labels array<string>, parts binary, codes binary, heap_sizes binary, heap_rows binary, heap_keys binary, moved array<struct<part: int, entry: int, n: long, sums: array<long>>>, rescanned long"
NAMES = ["ids", "labels", "parts", "codes", "heap_sizes", "heap_rows", "heap_keys", "moved", "rescanned"]


def whole(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite."""
    value = F.col(vector)
    low, high = (F.coalesce(f(vector).cast("double"), F.lit(0.0)) for f in (F.array_min, F.array_max))
    finite = ~F.isnan(high) & (high < float("inf")) & (low > float("-inf"))  # a NaN is the largest
    return F.coalesce(value.isNotNull() & ~F.exists(value, lambda x: x.isNull()) & finite, F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def split_parts(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows by PARTS by ``width``; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), PARTS * width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out.reshape(len(vectors), PARTS, width)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part to each entry: by products of floats where these are whole numbers below 2**53."""
    most = int(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, parts.shape[1]) < 1 << 53:
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(parts), len(entries)), dtype=np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((parts - entry) ** 2).sum(1)
    return out


class Heaps:
    """One heap for each entry of a part position. A heap is read when its least key is violated or a part comes to it."""

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, keys: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.rows, self.keys = rows, keys
        self.open: dict[int, list[tuple[float, int]]] = {}

    def least(self) -> np.ndarray:
        starts = self.ends - np.diff(self.ends, prepend=0)
        out = np.full(len(self.ends), np.inf)
        some = starts < self.ends
        out[some] = self.keys[starts[some]]
        return out

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            a, b = int(self.ends[entry - 1]) if entry else 0, int(self.ends[entry])
            self.open[entry] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
        return self.open[entry]

    def violated(self, drift: np.ndarray) -> list[int]:
        """Pops the rows whose bounds may not hold any more; a little more than the drift, for the rounding of roots."""
        out = []
        bound = drift + 1e-6 * (1 + drift)
        for entry in np.flatnonzero(self.least() <= bound).tolist():
            heap = self.heap(entry)
            while heap and heap[0][0] <= bound[entry]:
                out.append(heapq.heappop(heap)[1])
        return out

    def push(self, entry: int, key: float, row: int) -> None:
        heapq.heappush(self.heap(entry), (key, row))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, rows, keys), each heap in its own order, which is again a heap."""
        parts = []
        for entry in range(len(self.ends)):
            a, b = int(self.ends[entry - 1]) if entry else 0, int(self.ends[entry])
            if entry in self.open:
                heap = self.open[entry]
                parts.append((np.array([r for _, r in heap], dtype=np.int32), np.array([k for k, _ in heap], dtype=np.float64)))
            else:
                parts.append((self.rows[a:b], self.keys[a:b]))
        return np.array([len(r) for r, _ in parts], dtype=np.int32), np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])


class Books:
    """The codebooks of all part positions, and how far their entries have drifted."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # parts, entries, width
        self.drift = np.zeros(entries.shape[:2])
        self.sums = [[[0] * entries.shape[2] for _ in range(entries.shape[1])] for _ in range(PARTS)]
        self.counts = [[0] * entries.shape[1] for _ in range(PARTS)]

    def take(self, moved: list) -> None:
        """Adds what has moved to the sums, and moves the entries to the floors of their means."""
        for r in moved:
            m, j = r["part"], r["entry"]
            self.counts[m][j] += int(r["n"])
            for k, s in enumerate(r["sums"]):
                self.sums[m][j][k] += int(s)
        before = self.entries
        self.entries = before.copy()
        for m in range(PARTS):
            for j, n in enumerate(self.counts[m]):
                if n:
                    self.entries[m, j] = [s // n for s in self.sums[m][j]]
        step = np.sqrt(((self.entries - before).astype(np.float64) ** 2).sum(2))
        for m in range(PARTS):
            top = np.sort(step[m])[::-1]
            others = np.where(step[m] == top[0], top[1] if len(top) > 1 else 0.0, top[0])
            if (step[m] == top[0]).sum() > 1:
                others = np.full(len(step[m]), top[0])
            self.drift[m] += step[m] + others

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def _stored(parts: np.ndarray) -> bytes:
    """Parts in the narrowest whole numbers that hold them, the size of one in front."""
    for kind in ("<i2", "<i4", "<i8"):
        if np.abs(parts).max(initial=0) <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + parts.astype(kind).tobytes()
    raise AssertionError


def _read(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<i{blob[0]}", offset=1).astype(np.int64).reshape(-1, PARTS, width)


def _assign(parts: np.ndarray, codes: np.ndarray, heaps: list[Heaps], rows: list, books: Books, moved: np.ndarray, counts: np.ndarray) -> None:
    """Measures the given rows of each part position exactly, and puts them into the heap of their nearest entry."""
    for m in range(PARTS):
        if not len(rows[m]):
            continue
        at = np.array(sorted(rows[m]), dtype=np.int64)
        own = parts[at, m]
        found = distances(own, books.entries[m])
        nearest = found.argmin(1)
        best = found[np.arange(len(at)), nearest]
        found[np.arange(len(at)), nearest] = np.iinfo(np.int64).max
        second = np.sqrt(found.min(1).astype(np.float64)) if found.shape[1] > 1 else np.full(len(at), np.inf)
        keys = second - np.sqrt(best.astype(np.float64)) + books.drift[m][nearest]
        for row, j, key in zip(at.tolist(), nearest.tolist(), keys.tolist(), strict=True):
            heaps[m].push(j, key, row)
        changed = codes[at, m] != nearest
        was = codes[at, m][changed]
        old = was >= 0
        np.add.at(moved[m], nearest[changed], own[changed])
        np.add.at(counts[m], nearest[changed], 1)
        np.add.at(moved[m], was[old], -own[changed][old])
        np.add.at(counts[m], was[old], -1)
        codes[at, m] = nearest


def _block(ids: pa.Array, labels: pa.Array, parts: np.ndarray, codes: np.ndarray, heaps: list[Heaps]) -> list:
    sizes, rows, keys = zip(*[h.arrays() for h in heaps], strict=True)
    join = lambda arrays: np.concatenate(arrays).tobytes()
    return [ids, labels, _stored(parts), codes.astype(np.int16).tobytes(), join(sizes), join(rows), join(keys), [], 0]


def _batch(row: list) -> pa.RecordBatch:
    changed = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 5, pa.list_(changed), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], k) for v, k in zip(row, kinds, strict=True)], names=NAMES)


def _summed(moved: np.ndarray, counts: np.ndarray, rescanned: int) -> pa.RecordBatch:
    """What all blocks of a task moved, in a row of its own without vectors."""
    some = np.argwhere((counts != 0) | (moved != 0).any(2))
    rows = [{"part": int(m), "entry": int(j), "n": int(counts[m, j]), "sums": moved[m, j].tolist()} for m, j in some]
    return _batch([[], [], b"", b"", b"", b"", b"", rows, rescanned])


def _first_round(books: Books, width: int):
    """Packs the rows in blocks and assigns all of their parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = books.entries.shape[1]
        moved, counts = np.zeros(books.entries.shape, dtype=np.int64), np.zeros(books.entries.shape[:2], dtype=np.int64)
        scanned = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                lists = part.column("vector")
                flat, ends = scaled(lists.flatten().to_numpy(zero_copy_only=False)), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                parts = split_parts(np.split(flat, ends[:-1]), width)
                codes = np.full((len(parts), PARTS), -1, dtype=np.int64)
                none = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float64)
                heaps = [Heaps(np.zeros(n, dtype=np.int32), *none) for _ in range(PARTS)]
                _assign(parts, codes, heaps, [range(len(parts))] * PARTS, books, moved, counts)
                scanned += len(parts) * PARTS
                yield _batch(_block(part.column("id"), part.column("label"), parts, codes, heaps))
        yield _summed(moved, counts, scanned)

    return pack


def _next_round(books: Books, width: int):
    """Pops and measures the parts whose bounds the drift has violated, block by block."""

    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = books.entries.shape[1]
        moved, counts = np.zeros(books.entries.shape, dtype=np.int64), np.zeros(books.entries.shape[:2], dtype=np.int64)
        scanned = 0
        for batch in batches:
            for i in range(batch.num_rows):
                blobs = [batch.column(c)[i].as_py() for c in NAMES[2:7]]
                if not blobs[0]:
                    continue
                parts, codes = _read(blobs[0], width), np.frombuffer(blobs[1], dtype=np.int16).reshape(-1, PARTS).astype(np.int64)
                sizes = np.frombuffer(blobs[2], dtype=np.int32).reshape(PARTS, n)
                rows, keys = (np.frombuffer(b, dtype=k).reshape(PARTS, -1) for b, k in ((blobs[3], np.int32), (blobs[4], np.float64)))
                heaps = [Heaps(sizes[m], rows[m], keys[m]) for m in range(PARTS)]
                popped = [heaps[m].violated(books.drift[m]) for m in range(PARTS)]
                scanned += sum(map(len, popped))
                _assign(parts, codes, heaps, popped, books, moved, counts)
                yield _batch(_block(batch.column("ids")[i].values, batch.column("labels")[i].values, parts, codes, heaps))
        yield _summed(moved, counts, scanned)

    return renew


def _told(books: Books, width: int):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if not (blob := batch.column("parts")[i].as_py()):
                    continue
                parts, codes = _read(blob, width), np.frombuffer(batch.column("codes")[i].as_py(), dtype=np.int16).reshape(-1, PARTS)
                error = sum(((parts[:, m] - books.entries[m][codes[:, m]]) ** 2).sum(1) for m in range(PARTS))
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return tell


def _trained(vectors: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame | None, Books | None, int, list[int]]:
    """(blocks after the last assignment, codebooks, width of a part, parts measured in each round); None where no row is kept."""
    kept = vectors.where(whole(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    about = kept.agg(F.max(F.size("vector")).alias("size"), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("most")).first()
    if about["size"] is None:
        return None, None, 0, []
    if (about["most"] or 0) * SCALE >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE}")
    width = math.ceil(about["size"] / PARTS)
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    books = Books(np.ascontiguousarray(split_parts([scaled(np.array(r["vector"])) for r in first], width).transpose(1, 0, 2)))
    state, measured = None, []
    for turn in range(ROUNDS + 1):
        if state is None:
            now = written(kept.mapInArrow(_first_round(books, width), STATE), "codes")
        else:
            now = written(state.mapInArrow(_next_round(books, width), STATE), "codes")
            removed(state)
        state = now
        measured.append(state.agg(F.sum("rescanned")).first()[0])
        if turn < ROUNDS:
            moved = state.select(F.explode("moved").alias("m")).select("m.part", "m.entry", "m.n", F.posexplode("m.sums").alias("k", "s"))
            sums = moved.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            books.take(sums.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums")).collect())  # PARTS * ENTRIES rows at most
    return state, books, width, measured


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each kept vector: (id_col, code, error, label_error, codebooks_sha256).

    Vectors that are null or hold null or non-finite components are dropped. Components become floor(1024 x); vectors are cut into ``PARTS`` equal parts, each coded
    by its nearest of ``ENTRIES`` entries (ties to the lower number). Codebooks start from the vectors of the smallest ids, a null id last, equal ids by
    components; fewer vectors give fewer entries. Each of ``ROUNDS`` rounds moves every entry to the floor of its parts' mean, unused ones stay. Vectors
    of unequal lengths, or of one that is not a multiple of ``PARTS``, count as filled with zeros to the longest; empty ones are zero. Components of 131,072
    or more raise ValueError, as an error might not fit a long. label_error sums the errors of equal labels, nulls together. Every row counts, also those
    that repeat an id or a vector; a table without kept vectors gives an empty one. Other columns are not read.
    """
    state, books, width, _ = _trained(vectors, id_col, vector, label)
    names = [F.col("id").alias(id_col), "code", "error", "label_error"]
    if state is None:
        empty = vectors.sparkSession.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string")
        return empty.select(*names, "codebooks_sha256")
    coded = written(state.mapInArrow(_told(books, width), "id long, label string, code string, error long"), "coded")
    removed(state)
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "own")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("own")))
    return out.select(*names, F.lit(books.digest()).alias("codebooks_sha256"))
