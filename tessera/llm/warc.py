"""WARC writing, with identical payloads as revisits, and a salvage reader.

Each record is a gzip member of its own. The reader checks every member (gzip's CRC) and every record
(header, length, closing lines, payload digest). After a failed check it searches for the next place
where a whole valid member or a valid record at a version line begins, goes on from there, and logs the
bytes between as a quarantined gap; it never fails on damaged input.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import new_folder, written

from . import files

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # of capture: the tables have none
BYTES_A_FILE = 8 << 20
URN = "urn:x-page:"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

READ_SCHEMA = "file string, kind string, at long, size long, reason string, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"

_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or, given refers_to, a revisit of that response; both tell the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = "".join(c for c in (url or "") if c not in "\r\n")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean}"] if clean else []
    head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def parse_record(raw: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins at a version line and where it ends, or why it is not valid."""
    line = _VERSION_LINE.match(raw, at)
    if not line:
        return "no version line"
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        return "no end of header"
    fields = {}
    for row in raw[line.end() : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return "bad length"
    block = raw[end + 4 : end + 4 + length]
    stop = end + 4 + length
    if length < 0 or len(block) < length or raw[stop : stop + 4] != b"\r\n\r\n":
        return "bad length"
    if fields.get(b"warc-block-digest", f"sha1:{digest32(block)}") != f"sha1:{digest32(block)}":
        return "bad block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type", "")
    said = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and said and digest32(payload) != said:
        return "bad payload digest"
    told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    number = lambda key: int(m[1]) if (m := re.fullmatch(rf"<?{re.escape(URN)}(-?\d+)>?", fields.get(key, ""))) else None
    record = {
        "record_type": kind, "page_id": number(b"warc-record-id"), "url": fields.get(b"warc-target-uri"), "refers_to": number(b"warc-refers-to"), "payload_digest": said,
        "payload_bytes": int(told[1]) if told else len(payload), "payload": payload if kind == "response" else None,
    }
    return record, stop + 4


def _plain_records(plain: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(begin, end, record or reason) of plain bytes, in order: after a record that is not valid, on from the next version line."""
    at, gap, reason = 0, None, ""
    while at < len(plain):
        got = parse_record(plain, at)
        if isinstance(got, str):
            gap, reason = (at, got) if gap is None else (gap, reason)
            nxt = _VERSION_LINE.search(plain, at + 1)
            at = nxt.start() if nxt else len(plain)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, got[1], got[0]
        at = got[1]
    if gap is not None:
        yield gap, len(plain), reason


def _unpacked(raw: bytes, at: int, step: int) -> tuple[bytes, int | None, str]:
    """The bytes of the gzip member that begins here as far as they unpack, and where it ends: None, with a reason, if it is damaged or cut off."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(raw):
            parts.append(unpack.decompress(raw[end : end + step]))
            end = min(end + step, len(raw))
    except zlib.error as e:
        return b"".join(parts), None, f"bad member: {e}"[:80]
    return b"".join(parts), end - len(unpack.unused_data) if unpack.eof else None, "" if unpack.eof else "cut-off member"


def _member_at(raw: bytes, at: int) -> tuple[list[tuple[int, int, dict | str]], int | None, str]:
    """What the gzip member that begins here holds (see ``_plain_records``), its end and what is wrong with it.

    Of a member whose own check did not pass, a record counts only if another begins behind it.
    """
    plain, end, reason = _unpacked(raw, at, 1 << 16)
    if not reason:
        return list(_plain_records(plain)), end, ""
    plain, _, reason = _unpacked(raw, at, 64)  # a step that fails gives nothing: small ones lose little before the damage
    return [x for x in _plain_records(plain) if not isinstance(x[2], str) and _VERSION_LINE.match(plain, x[1])], None, reason


def salvage(raw: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", at, size, fields) and ("gap", at, size, reason) of an archive's bytes, in order.

    Their ranges cover all bytes. Records of one gzip member share its range. A gap inside a member has its range too, and its
    reason tells the place in the unpacked bytes; a damaged member's gap tells how many records were recovered from what did unpack.
    """
    at, gap, reason = 0, None, ""
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            held, end, why = _member_at(raw, at)
        else:
            got = parse_record(raw, at)
            held, end, why = ([], None, got) if isinstance(got, str) else ([(at, got[1], got[0])], got[1], "")
        if end is None and not held:
            if gap is None:
                gap, reason = at, why
            nxt = _START.search(raw, at + 1)
            at = nxt.start() if nxt else len(raw)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        if end is None:
            nxt = _START.search(raw, at + 1)
            end = nxt.start() if nxt else len(raw)
            yield "gap", at, end - at, f"{why}; {len(held)} records recovered"
        for begin, stop, what in held:
            yield ("gap", at, end - at, f"{what}, unpacked bytes {begin} to {stop}") if isinstance(what, str) else ("record", at, end - at, what)
        at = end
    if gap is not None:
        yield "gap", gap, len(raw) - gap, reason


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, bytes_a_file: int = BYTES_A_FILE) -> DataFrame:
    """Write one record for each row; returns the manifest (name, records, bytes).

    Of rows with equal payloads of at least ``least_bytes`` the one with the smallest id is a response and the
    others revisit it; smaller payloads are all responses. Rows that share that smallest id are all responses, as are rows
    with a null id. Payloads are UTF-8, null as empty. Payloads are
    grouped by SHA-256 and length alone, and no payload moves with its group.
    """
    files.make_folder(folder)
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), raw.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("n", F.octet_length("payload"))
    keys = rows.where(F.col("n") >= least_bytes).select("id", "key")
    first = written(keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")  # a table of its own: a frequent payload's rows can be split
    again = keys.join(first, "key").where("id <> first").select("id", "key", "first").distinct()
    told = rows.join(again, ["id", "key"], "left").select("id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        n = seq = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.warc.gz"
            files.put(folder, name, b"".join(held))
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([n], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page, link, data, first_id = (batch.column(c)[i].as_py() for c in range(4))
                held.append(member(make_record(page, link, data, first_id)))
                n += len(held[-1])
                if n >= bytes_a_file:
                    yield flush()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield flush()

    ordered = told.sortWithinPartitions("id", "url", "payload")
    return written(ordered.mapInArrow(write, "name string, records long, bytes long"), "manifest")


def read_archives(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record (kind ``record``) and each quarantined run of bytes (kind ``gap``, with its reason) of the archives in a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for kind, at, size, what in salvage(content.as_py()):
                    row = {"file": path.as_py(), "kind": kind, "at": at, "size": size}
                    rows.append(row | ({"reason": what} if kind == "gap" else what | ({} if with_payload else {"payload": None})))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return found.mapInArrow(read, READ_SCHEMA)


def warc_roundtrip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload; null and empty urls give a record without target. Repeated rows of one id
    are records of their own, as are rows without an id, which nothing revisits. An empty table gives an empty table. Other columns are not read.
    """
    folder = new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    records = read_archives(pages.sparkSession, folder, with_payload=False).where("kind = 'record'")
    ours = records.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(manifest.select("name"), "name", "left_semi")
    return ours.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
