"""BPE encoding and decoding with a byte-level tokenizer file, equal to the tokenizers library's.

A text is cut before white space that follows another character: no pre-token spans such a place and none
looks across it, so the units between cuts encode alone. Units are hashed over a whole block of texts,
each distinct one is encoded once per worker, and ids are gathered by numpy. Long units, which have no such
place, go by tree concatenation: halves of each pre-token are encoded apart, and around each join a window
of growing width is encoded anew until its ends agree with both sides. Agreement of two tokens means
that their joint bytes encode to just these two; a sequence all of whose neighbours agree is the encoding.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, blocks, byte_values, span_hashes

LEAF = 1024  # bytes of a unit, and characters of a pre-token, above which halves are encoded apart
CACHE_MOST = 2_000_000  # units that a worker remembers (about 100 MB); beyond, it starts afresh
RUN = 4096  # units encoded in one call
SPECIAL = b"<|endoftext|>"
_SECOND = byte_values(0x5EED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in set(plain)):
        shown[chr(256 + extra)] = b
    return shown


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space outside ASCII or the special token's string, which units must not be cut by: see ``Codec.encode_odd``."""
    lead = np.zeros(256, dtype=bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    at = np.flatnonzero(lead[data])
    at = at[at + 1 < len(data)]
    a, b = data[at], data[at + 1]
    c = data[np.minimum(at + 2, len(data) - 1)] if len(data) else a
    space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    space |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found = at[space].tolist()
    raw = data.tobytes()
    i = raw.find(SPECIAL)
    while i >= 0:
        found.append(i)
        i = raw.find(SPECIAL, i + 1)
    return np.unique(np.searchsorted(offsets, found, side="right") - 1) if found else np.empty(0, dtype=np.int64)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = space[data[1:]] & (data[:-1] > 32)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class Codec:
    """Encoder and decoder of one tokenizer file; one per worker process (see ``codec``)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer(self.tokenizer.model)
        alphabet = byte_alphabet()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        self.special = names[SPECIAL.decode()]
        for name, i in names.items():
            self.names[i] = name
        pieces = [bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in self.names]
        self.piece_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.agree = lru_cache(1 << 16)(lambda a, b: self._bare([self.names[a] + self.names[b]])[0] == [a, b])
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=U64)
        self.checks = np.empty(0, dtype=U64)
        self.at = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int32)
        self.pool = np.empty(0, dtype=np.uint32)

    def _bare(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(pieces, add_special_tokens=False)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joint bytes of two encodings, within one pre-token."""
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        width = 8
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self._bare(["".join(self.names[i] for i in left[a:] + right[:b])])[0]
            if (a == 0 or self.agree(left[a - 1], middle[0])) and (b == len(right) or self.agree(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def tree(self, piece: str, leaf: int = LEAF) -> list[int]:
        """One pre-token: all leaves are encoded in one batch, then joined pairwise, level by level."""
        count = 1
        while len(piece) > count * leaf:
            count *= 2
        step = -(-len(piece) // count)
        level = self._bare([piece[i : i + step] for i in range(0, len(piece), step)])
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def encode_long(self, text: str, leaf: int = LEAF) -> list[int]:
        """A text without the special token's string, pre-token by pre-token: long ones by tree concatenation, the rest in one batch."""
        pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        short = iter(self._bare([p for p in pieces if len(p) <= leaf]))
        return [i for p in pieces for i in (self.tree(p, leaf) if len(p) > leaf else next(short))]

    def encode_odd(self, text: str, leaf: int = LEAF) -> list[int]:
        """A text cut at the special token's string, each part as by ``encode_long``."""
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL.decode())):
            ids += [self.special] * (k > 0) + self.encode_long(part, leaf)
        return ids

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Units with white space before a printable end stay apart when joined, so runs of them are encoded in one call."""
        out: list[list[int]] = [[]] * len(units)
        joined, single = [], []
        for i, u in enumerate(units):
            if len(u) > LEAF:
                out[i] = self.encode_long(u.decode())
            else:
                (joined if u[0] <= 32 and u[-1] > 32 else single).append(i)
        encoded = self.tokenizer.encode_batch_fast([units[i].decode() for i in single], add_special_tokens=False)
        for i, e in zip(single, encoded, strict=True):
            out[i] = e.ids
        for at in range(0, len(joined), RUN):
            run = joined[at : at + RUN]
            text = b"".join(units[i] for i in run).decode()
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.piece_len[np.array(ids, dtype=np.int64)])
            cuts = np.searchsorted(ends, np.cumsum([len(units[i]) for i in run]), side="left") + 1
            if len(ends) and not np.array_equal(ends[cuts - 1], np.cumsum([len(units[i]) for i in run])):
                raise RuntimeError("a token spans two units")
            begin = 0
            for i, end in zip(run, cuts.tolist(), strict=True):
                out[i] = ids[begin:end]
                begin = end
        return out

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size in the pool of the ids of each unit."""
        keys, checks = span_hashes(data, starts, ends), span_hashes(data, starts, ends, _SECOND)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        own = checks[first]
        if not np.array_equal(own[inverse], checks):
            raise ValueError("two units share a 64-bit hash")
        if len(self.keys) > CACHE_MOST:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        if len(self.keys) and not np.array_equal(self.checks[place][known], own[known]):
            raise ValueError("two units share a 64-bit hash")
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            ids = self._encode_units([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            at = len(self.pool) + np.concatenate([[0], np.cumsum(sizes)])[:-1]
            flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum()))
            self.pool = np.concatenate([self.pool, flat])
            where = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, where, distinct[new])
            self.checks = np.insert(self.checks, where, own[new])
            self.at = np.insert(self.at, where, at)
            self.sizes = np.insert(self.sizes, where, sizes)
            place = np.searchsorted(self.keys, distinct)
        return self.at[place][inverse], self.sizes[place][inverse].astype(np.int64)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and their offsets by text."""
        n = len(offsets) - 1
        odd = odd_texts(data, offsets)
        whole = [self.encode_odd(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in odd]
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        try:
            at, sizes = self._lookup(data, starts, ends)
        except ValueError:  # as good as never: encode the block's texts one by one
            lists = [self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in range(n)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return np.array([i for x in lists for i in x], dtype=np.uint32), bounds
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(at - sums[:-1], sizes) + np.arange(sums[-1])]
        bounds = sums[np.searchsorted(starts, offsets)]
        if len(odd):
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i, e in zip(odd.tolist(), whole, strict=True):
                parts[i] = np.array(e, dtype=np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, bounds

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Joint bytes of the tokens; like the library, ill-formed UTF-8 becomes U+FFFD. Ids outside the vocabulary count as empty."""
        ids = ids[ids < len(self.names)]
        sizes = self.piece_len[ids]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.piece_bytes[np.repeat(self.piece_at[ids] - sums[:-1], sizes) + np.arange(sums[-1])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every text; null counts as empty and gives an empty list."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                ids, bounds = codec(path).encode_block(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_col, text) of lists of ids; a null list gives an empty text."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode_bytes(np.array(x.as_py() or [], dtype=np.uint32)).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, text string")


def roundtrip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id_col, n_tokens, ids_sha256, decoded_sha256).

    Encode and decode in one task, so that ids do not cross processes. ids_sha256 digests the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 the decoded text in UTF-8. Null and empty texts have no
    ids. Repeated rows each give a row; an empty table gives an empty table. Other columns are not read.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                own = codec(path)
                ids, bounds = own.encode_block(data, offsets)
                lists = [ids[bounds[i] : bounds[i + 1]] for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists], pa.string()),
                        pa.array([hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in lists], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
