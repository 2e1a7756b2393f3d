"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds whole documents in ascending id order. Its ids are replaced by their rank by frequency within
the file (the table of ranks is in the file), so that common ids take one byte. Four 2-bit sizes share a
control byte, control bytes stand apart from data bytes, and both are decoded by numpy table lookup.

Layout, little-endian: magic, counts of documents, tokens and distinct ids (3 x u64), distinct ids by rank
(u32), document ids (i64), tokens per document (u64), control bytes, data bytes, CRC-32 of all before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import new_folder, written

from . import files
from .bpe import codec, default_tokenizer
from .textkit import blocks

MAGIC = b"TSRTOK1\n"
END_ID = 2
TOKENS_A_FILE = 4 << 20
NULL_ID = -(1 << 63)  # stands for a null document id
SIZES = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    fours = codes.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    sizes = codes[: len(values)] + np.uint8(1)
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    data = np.empty(int(ends[-1]) if len(values) else 0, dtype=np.uint8)
    data[starts] = values.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if len(more):
            data[starts[more] + k] = (values[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(values, data bytes used)."""
    sizes = SIZES[control].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        values[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values, int(ends[-1]) if n else 0


def to_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)  # ids are below the vocabulary's size: counting needs no sort
    order = np.argsort(-counts, kind="stable")
    distinct = order[: np.count_nonzero(counts)]
    rank = np.empty(len(counts), dtype=np.uint32)
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    control, data = pack(rank[ids])
    head = np.array([len(doc_ids), len(ids), len(distinct)], dtype="<u8").tobytes()
    body = b"".join([MAGIC, head, distinct.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), control, data])
    return body + zlib.crc32(body).to_bytes(4, "little")


def from_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, tokens per document, all token ids); a file that fails its checks raises."""
    if raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("not a whole token file")
    n_docs, n, n_distinct = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    table = np.frombuffer(raw, "<u4", n_distinct, at)
    at += 4 * n_distinct
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    values, used = unpack(control, np.frombuffer(raw, np.uint8, len(raw) - 4 - at - len(control), at + len(control)), n)
    if at + len(control) + used + 4 != len(raw) or int(lengths.sum()) != n:
        raise ValueError("a token file's sizes do not agree")
    return doc_ids, lengths, table[values]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, tokens_a_file: int = TOKENS_A_FILE) -> DataFrame:
    """Encode all texts, append end_id to each, and write files in ascending id order; returns the manifest.

    The manifest has (name, part, seq, docs, tokens) for each file, in order of part and seq. Null and empty
    texts have the end id alone. Null ids come first; texts of one id follow each other in order of the text.
    """
    path = path or default_tokenizer()
    files.make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, np.ndarray]] = []
        n = seq = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.tok"
            lengths = np.array([len(x) for _, x in held], dtype=np.int64)
            files.put(folder, name, to_file(np.array([i for i, _ in held], dtype=np.int64), lengths, np.concatenate([x for _, x in held])))
            return pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(held)], pa.int64()), "tokens": pa.array([n], pa.int64())})

        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                ids, bounds = codec(path).encode_block(data, offsets)
                for i, doc in enumerate(rows.column("id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    held.append((NULL_ID if doc is None else doc, own))
                    n += len(own)
                    if n >= tokens_a_file:
                        yield flush()
                        held, n, seq = [], 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(write, "name string, part int, seq int, docs long, tokens long"), "manifest")


def read_tokens(folder: str, manifest: DataFrame, kernel, schema: str) -> DataFrame:
    """Rows that ``kernel(doc_ids, starts, lengths, ids)`` makes of each file of the manifest; other files are left alone."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each writing task
    parts = parts.select("part", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(parts, "part").select("name", (F.col("base") + F.col("inside")).alias("base"))
    found = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(starts, "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, base in zip(batch.column("content"), batch.column("base"), strict=True):
                doc_ids, lengths, ids = from_file(raw.as_py())
                ends = np.cumsum(lengths)
                yield kernel([None if i == NULL_ID else i for i in doc_ids.tolist()], base.as_py() + ends - lengths, lengths, ids)

    return found.select("content", "base").mapInArrow(read, schema)


def _checksums(doc_ids: list, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    ends = np.cumsum(lengths)
    sums = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def token_files_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32).

    start counts the ids of all documents before, in ascending doc_id order; n_tokens has the end id. Repeated
    rows each give a row; an empty table gives an empty table. Other columns are not read.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, path)
    return read_tokens(folder, manifest, _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
