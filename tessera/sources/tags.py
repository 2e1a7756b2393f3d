"""Shooting data of image files: the graph of tag directories of TIFF-like files, alone or inside JPEG, PNG and RAF files.

Directories are read from bytes in either order, with values in the entry or at an offset. A directory is read once, so cycles end;
an entry that points outside of the file is left out, a file cut short gives what can be read.
"""

from __future__ import annotations

import math
import struct
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the format's value types and their struct codes.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
#: Tag numbers.
IMAGE = {"make": 0x010F, "model": 0x0110, "orientation": 0x0112, "width": 0x0100, "height": 0x0101}
EXIF = {
    "exposure_time": 0x829A, "f_number": 0x829D, "iso": 0x8827, "date_time_original": 0x9003, "offset_time": 0x9010, "exposure_bias": 0x9204, "subject_distance": 0x9206,
    "focal_length": 0x920A, "maker_note": 0x927C, "subsec_time": 0x9291, "width": 0xA002, "height": 0xA003, "white_balance": 0xA403, "focal_length_35mm": 0xA405,
    "body_serial": 0xA431, "lens_make": 0xA433, "lens_model": 0xA434, "lens_serial": 0xA435,
}
GPS = {"lat_ref": 1, "lat": 2, "lon_ref": 3, "lon": 4, "alt_ref": 5, "alt": 6}
BRANCHES = {0x8769: "exif", 0x8825: "gps", 0x014A: "sub"}
SONY_STYLE, SIGMA_STYLE, FUJI_STYLE = 0xB020, 0x003D, 0x1401
#: Film modes by number.
FILM_MODES = {
    0x000: "Provia", 0x100: "Studio Portrait", 0x110: "Studio Portrait Enhanced Saturation", 0x120: "Astia", 0x130: "Studio Portrait Increased Sharpness", 0x200: "Velvia",
    0x300: "Studio Portrait Ex", 0x400: "Velvia", 0x500: "Pro Neg. Std", 0x501: "Pro Neg. Hi", 0x600: "Classic Chrome", 0x700: "Eterna", 0x800: "Classic Negative",
}

SCHEMA = (
    "camera_make string, camera string, lens string, lens_make string, focal_length double, aperture double, iso double, date_time_original string, width int, height int, "
    "style string, latitude double, longitude double, altitude double, exposure_time string, exposure_bias double, orientation int, white_balance string, focal_length_35mm int, "
    "offset_time string, body_serial string, lens_serial string, subject_distance double, subsec_time string"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
NONE = (0, (), 0)
Entries = dict[int, tuple[int, tuple, int]]


def directory(data: bytes, order: str, at: int, base: int = 0) -> tuple[Entries, int]:
    """(tag to (kind, values, place of the values), offset of the next directory or 0) of the directory at ``at``; values outside stand at ``base`` plus their offset."""
    if not 0 <= at <= len(data) - 2:
        return {}, 0
    (count,) = struct.unpack_from(order + "H", data, at)
    found: Entries = {}
    for k in range(count):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            return found, 0
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        code = KINDS.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * n
        where = place + 8 if size <= 4 else base + struct.unpack_from(order + "I", data, place + 8)[0]
        if 0 <= where and where + size <= len(data):
            found.setdefault(tag, (kind, (bytes(data[where : where + size]),) if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, where), where))
    after = at + 2 + 12 * count
    return found, struct.unpack_from(order + "I", data, after)[0] if after + 4 <= len(data) else 0


def directories(data: bytes) -> tuple[dict[str, Entries], str]:
    """The directories of a TIFF file by name (image, exif, gps, sub; of several the first wins for each tag), and its byte order; none if it is no such file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]), "")
    if not order or len(data) < 8:
        return {}, ""
    named: dict[str, Entries] = {}
    seen: set[int] = set()
    todo = [("image", struct.unpack_from(order + "I", data, 4)[0])]
    while todo:
        name, at = todo.pop(0)
        if at in seen or at == 0:
            continue
        seen.add(at)
        entries, after = directory(data, order, at)
        for tag, value in entries.items():
            named.setdefault(name, {}).setdefault(tag, value)
        todo += [(BRANCHES[tag], offset) for tag in BRANCHES if tag in entries and entries[tag][0] in (3, 4, 13) for offset in entries[tag][1]]
        todo += [("next", after)]
    return named, order


def embedded(data: bytes) -> tuple[bytes, int | None, int | None]:
    """(the TIFF part of a file, width, height as its container tells them)."""
    if data[:2] == b"\xff\xd8":
        at, tiff, width, height = 2, b"", None, None
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if marker == 0xE1 and body[:6] == b"Exif\0\0" and not tiff:
                tiff = body[6:]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5 and width is None:
                height, width = struct.unpack_from(">HH", body, 1)
            if marker == 0xDA or size < 2:
                break
            at += 2 + size
        return tiff, width, height
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, tiff, width, height = 8, b"", None, None
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR" and len(body) >= 8:
                width, height = struct.unpack_from(">II", body)
            elif kind == b"eXIf":
                tiff = body
            at += 12 + size
        return tiff, width, height
    if data[:15] == b"FUJIFILMCCD-RAW" and len(data) >= 92:
        at, size = struct.unpack_from(">II", data, 84)
        return embedded(data[at : at + size]) if data[at : at + 2] == b"\xff\xd8" else (b"", None, None)
    return data, None, None


def text_of(entries: Entries, tag: int) -> str | None:
    kind, values, _ = entries.get(tag, NONE)
    if kind not in (2, 7) or not values:
        return None
    return values[0].split(b"\0")[0].decode("utf-8", "replace").strip() or None


def numbers_of(entries: Entries, tag: int) -> list[float]:
    """The numbers of an entry; a fraction of nothing ends the list."""
    kind, values, _ = entries.get(tag, NONE)
    if kind in (0, 2, 7):
        return []
    if kind in (5, 10):
        values = tuple(a / b if b else math.nan for a, b in zip(values[::2], values[1::2], strict=True))
    return list(values) if all(math.isfinite(v) for v in values) else []


def _first(entries: Entries, tag: int) -> float | None:
    return next(iter(numbers_of(entries, tag)), None)


def _whole(entries: Entries, tag: int) -> int | None:
    value = _first(entries, tag)
    return None if value is None or not -(1 << 31) <= value < 1 << 31 else int(value)


def _degrees(entries: Entries, tag: int, ref: int, negative: str) -> float | None:
    parts, side = numbers_of(entries, tag), text_of(entries, ref)
    if not parts or side is None:
        return None
    value = sum(p / 60**k for k, p in enumerate(parts[:3]))
    return -value if side == negative else value


def exposure_text(seconds: float | None) -> str | None:
    """1/125 for parts of a second, else the seconds."""
    if seconds is None or seconds < 0:
        return None
    return f"1/{round(1 / seconds)}" if 0 < seconds < 1 and round(1 / seconds) > 1 else f"{seconds:g}"


def note_text(note: bytes, tag: int) -> str:
    """The text of a tag of a maker note that is kept alone: its directory is little-endian, at byte 10, and offsets count from the file that it was in.

    Values follow the directory, so the least offset of all tells where the note began. '' if there is no such text.
    """
    if note[:5] != b"SIGMA" or len(note) < 14:
        return ""
    count = int.from_bytes(note[10:12], "little")
    end = 12 + 12 * count
    heads = [struct.unpack_from("<HHII", note, 12 + 12 * k) for k in range(count) if 24 + 12 * k <= len(note)]
    far = [at for _, kind, n, at in heads if struct.calcsize("<" + KINDS.get(kind, "B")) * n > 4]
    entries, _ = directory(note, "<", 10, min(0, end - min(far)) if far else 0)
    return text_of(entries, tag) or "" if entries.get(tag, NONE)[0] == 2 else ""


def style_of(tiff: bytes, order: str, exif: Entries) -> str | None:
    """The picture style in the maker note: a text of Sony's or Sigma's, else Fujifilm's film mode."""
    _, values, at = exif.get(EXIF["maker_note"], NONE)
    note = values[0] if values else b""
    if not isinstance(note, bytes) or not note:
        return None
    if note[:5] == b"SIGMA":
        return note_text(note, SIGMA_STYLE) or None
    if note[:8] == b"FUJIFILM" and len(note) >= 12:
        code = _whole(directory(note, "<", int.from_bytes(note[8:12], "little"))[0], FUJI_STYLE)
        return None if code is None else FILM_MODES.get(code, f"({code})")
    head = 12 if note[:4] == b"SONY" else 0
    return text_of(directory(tiff, order, at + head)[0], SONY_STYLE)


def read_tags(data: bytes | None) -> dict[str, Any]:
    """The fields of ``SCHEMA`` of one file; what is missing or damaged is None."""
    out: dict[str, Any] = dict.fromkeys(FIELDS)
    if not data:
        return out
    tiff, width, height = embedded(bytes(data))
    named, order = directories(tiff)
    image, exif, gps = (named.get(n, {}) for n in ("image", "exif", "gps"))
    for field, tag in (("camera_make", IMAGE["make"]), ("camera", IMAGE["model"])):
        out[field] = text_of(image, tag)
    for field, name in (("lens", "lens_model"), ("lens_make", "lens_make"), ("date_time_original", "date_time_original"), ("offset_time", "offset_time"), ("body_serial", "body_serial"), ("lens_serial", "lens_serial"), ("subsec_time", "subsec_time")):
        out[field] = text_of(exif, EXIF[name])
    for field, name in (("focal_length", "focal_length"), ("aperture", "f_number"), ("iso", "iso"), ("exposure_bias", "exposure_bias"), ("subject_distance", "subject_distance")):
        value = _first(exif, EXIF[name])
        out[field] = None if value is None else float(value)
    for field, shown in (("width", width), ("height", height)):
        out[field] = _whole(exif, EXIF[field]) or _whole(image, IMAGE[field]) or shown
    out["orientation"], out["focal_length_35mm"] = _whole(image, IMAGE["orientation"]), _whole(exif, EXIF["focal_length_35mm"])
    out["exposure_time"] = exposure_text(_first(exif, EXIF["exposure_time"]))
    balance = _whole(exif, EXIF["white_balance"])
    out["white_balance"] = None if balance is None else {0: "Auto", 1: "Manual"}.get(balance, f"({balance})")
    out["latitude"], out["longitude"] = _degrees(gps, GPS["lat"], GPS["lat_ref"], "S"), _degrees(gps, GPS["lon"], GPS["lon_ref"], "W")
    height_m = _first(gps, GPS["alt"])
    out["altitude"] = None if height_m is None else -float(height_m) if _whole(gps, GPS["alt_ref"]) == 1 else float(height_m)
    out["style"] = style_of(tiff, order, exif) if order else None
    return out


def with_tags(df: DataFrame, content: str = "content", out: str = "tags") -> DataFrame:
    """Adds a struct of ``SCHEMA`` read from the bytes of each file, in Arrow batches; null and unreadable bytes give null fields."""

    @F.pandas_udf(SCHEMA)
    def read(blobs: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([read_tags(b) for b in blobs], columns=FIELDS)
        return rows.astype({c: "Int32" for c in ("width", "height", "orientation", "focal_length_35mm")} | {c: "float64" for c in ("focal_length", "aperture", "iso", "latitude", "longitude", "altitude", "exposure_bias", "subject_distance")})

    return df.withColumn(out, read(F.col(content)))


def read_file_tags(spark: SparkSession, root: str) -> DataFrame:
    """(path, tags) of all files below a folder. A file is one row while it is read, so one of 2 GB or more is not for this source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return with_tags(files).select("path", "tags")
