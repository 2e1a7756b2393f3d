"""Vectorised hashing of words in Arrow batches of text, shared by the text operators.

A block is a run of whole texts of about ``BLOCK_BYTES``; numpy works on all of its bytes at once, so
memory is bounded by the block, not by the partition. A single longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: multiply and xor-shift, two rounds."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB) + U64(seed))


_VALUES = byte_values(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets): null texts count as empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes inside each text, and the index of each text's first word."""
    inside = word_byte[data]
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first] = inside[first]
        stop[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum over the block."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x8EBC6AF09C88C6E3))


def sequence_hash(words: np.ndarray) -> int:
    """A hash of a whole sequence of word hashes, apart from those of fixed-length windows."""
    total = np.array([len(words) + 0x51ED27], dtype=U64)
    for word in words:
        total = mix(total * U64(0x2545F4914F6CDD1D) + word)
    return int(total[0])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words of the block; runs over the end of a text are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    factors = mix(np.arange(1, width + 1, dtype=U64) * U64(0x589965CC75374CC3)) | U64(1)
    total = words[:n] * factors[0]
    for j in range(1, width):
        total += words[j : n + j] * factors[j]
    return mix(total)


def folded(letters: bool = True) -> np.ndarray:
    """A byte table that lower-cases A-Z and leaves all else alone."""
    table = np.arange(256, dtype=np.uint8)
    if letters:
        table[65:91] += 32
    return table
