"""Sources and sinks: file listings, JSON libraries, GPX tracks, XMP sidecars, colour cubes, packed vectors, correction steps, maker notes, foreign catalogues."""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.functions import text

from . import tags


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(id, path, filename, file_size, class) of the media files below a folder; contents are not read. id is name_size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", F.col("length").alias("file_size"))
    named = found.select("path", text.file_name("path").alias("filename"), "file_size", text.media_class(text.extension("path")).alias("class")).where("class <> ''")
    return named.select(F.concat_ws("_", "filename", F.col("file_size").cast("string")).alias("id"), "path", "filename", "file_size", "class")


def new_files(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Of the files whose key is not known yet, one for each key: the first by path."""
    return found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), "path").alias("f")).select(key, "f.*").join(known.select(key), key, "left_anti")


def read_library_json(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object], field: str = "photos") -> DataFrame:
    """Entries of a JSON document's list; keys that are missing take their default."""
    whole = StructType().add(field, ArrayType(schema))
    rows = spark.read.schema(whole).option("multiLine", "true").json(path).select(F.explode(field).alias("p")).select("p.*")
    return rows.select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else F.col(f.name) for f in schema.fields])


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, time) of all track points, time in epoch seconds; an offset after the seconds is ignored, as is a point without a time."""
    points = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, time string").load(path)
    seconds = F.unix_timestamp(F.try_to_timestamp(F.substring("time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return points.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), seconds.alias("time")).where("time > 0")


def read_xmp(spark: SparkSession, path: str) -> DataFrame:
    """(path, rating, label, memo, tags, latitude, longitude, altitude) of sidecars, whose values are attributes or elements of the description.

    rating is cut to 0 to 5; memo is the first text of the description, tags a JSON array of the subjects ('' if there are none); an altitude
    below sea level is negative. What is missing is 0 or ''.
    """
    rows = spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "value")

    def value(tag: str) -> Column:
        plain, element = F.regexp_extract("value", rf'{tag}\s*=\s*"([^"]*)"', 1), F.regexp_extract("value", rf"<{tag}>([^<]*)</{tag}>", 1)
        return text.xml_unescaped(F.when(plain != "", plain).otherwise(element))

    def items(tag: str) -> Column:
        block = F.regexp_extract("value", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
        return F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), 1), text.xml_unescaped), lambda x: x != "")

    memo, tags = items("dc:description"), items("dc:subject")
    height = F.coalesce(text.rational(value("exif:GPSAltitude")), F.lit(0.0))
    return rows.select(
        "path", F.least(F.greatest(F.coalesce(value("xmp:Rating").try_cast("int"), F.lit(0)), F.lit(0)), F.lit(5)).alias("rating"), text.color_label(value("xmp:Label")).alias("label"),
        F.coalesce(F.get(memo, F.lit(0)), F.lit("")).alias("memo"), F.when(F.size(tags) > 0, F.to_json(tags)).otherwise("").alias("tags"),
        text.xmp_coordinate(value("exif:GPSLatitude")).alias("latitude"), text.xmp_coordinate(value("exif:GPSLongitude")).alias("longitude"),
        F.when(value("exif:GPSAltitudeRef") == "1", -height).otherwise(height).alias("altitude"),
    )


XMP_NAMES = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xmp": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/"}


def merged_sidecar(old: str | None, rating: int, label: str, memo: str, tags: str) -> str:
    """A sidecar with the given values; all else that ``old`` has stays. An empty label, memo or list of tags takes that field away."""
    name = lambda prefix, tag: f"{{{XMP_NAMES[prefix]}}}{tag}"
    for prefix, uri in XMP_NAMES.items():
        ET.register_namespace(prefix, uri)
    for prefix, uri in re.findall(r'xmlns:(\w+)="([^"]+)"', old or ""):
        if prefix not in XMP_NAMES and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(re.sub(r"<\?xpacket[^>]*\?>", "", old).strip()) if old else ET.Element(name("x", "xmpmeta"))
    rdf = root if root.tag == name("rdf", "RDF") else root.find(name("rdf", "RDF"))
    rdf = ET.SubElement(root, name("rdf", "RDF")) if rdf is None else rdf
    about = rdf.find(name("rdf", "Description"))
    about = ET.SubElement(rdf, name("rdf", "Description"), {name("rdf", "about"): ""}) if about is None else about
    for each in rdf.findall(name("rdf", "Description")):
        for field in (name("xmp", "Rating"), name("xmp", "Label"), name("dc", "description"), name("dc", "subject")):
            each.attrib.pop(field, None)
            for child in each.findall(field):
                each.remove(child)
    about.set(name("xmp", "Rating"), str(rating))
    if label:
        about.set(name("xmp", "Label"), label)
    try:
        listed = json.loads(tags) if tags else []
    except ValueError:
        listed = []
    for tag, kind, texts in (("description", "Alt", [memo] if memo else []), ("subject", "Bag", [t for t in listed if isinstance(t, str)] if isinstance(listed, list) else [])):
        if texts:
            holder = ET.SubElement(ET.SubElement(about, name("dc", tag)), name("rdf", kind))
            for t in texts:
                item = ET.SubElement(holder, name("rdf", "li"), {"{http://www.w3.org/XML/1998/namespace}lang": "x-default"} if kind == "Alt" else {})
                item.text = t
    return ET.tostring(root, encoding="unicode")


def with_sidecars(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, xml) of the managed rows (path, rating, label, memo, tags, managed) that have a path, merged with the ``existing`` sidecars (path, xml)."""

    @F.pandas_udf("string")
    def merge(old: pd.Series, rating: pd.Series, label: pd.Series, memo: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([merged_sidecar(*values) for values in zip(old, rating, label, memo, tags, strict=True)])

    own = rows.where("managed and path <> ''").withColumn("path", text.sidecar_path("path"))
    both = own.join(existing.select("path", F.col("xml").alias("__old")), "path", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return both.select("path", merge("__old", F.coalesce("rating", F.lit(0)), blank("label"), blank("memo"), blank("tags")).alias("xml"))


def write_texts(texts: DataFrame, path: str = "path", body: str = "xml") -> None:
    """Each row's text as a file of its own: written beside it, then renamed, so that a task that runs again does no harm."""

    def put(rows: Iterator) -> None:
        for row in rows:
            fs, target = pafs.FileSystem.from_uri(row[path]) if "://" in row[path] or row[path].startswith("file:") else (pafs.LocalFileSystem(), row[path])
            part = f"{target}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(row[body].encode())
            fs.move(part, target)

    texts.select(path, body).foreachPartition(put)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, ri, gi, bi, r, g, b): the nodes of ``.cube`` tables, red fastest. A table is one file of bounded size; comments and other keys are passed over."""
    whole = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.cube").option("recursiveFileLookup", "true").load(path)
    size = F.regexp_extract("value", r"(?m)^LUT_3D_SIZE\s+(\d+)", 1).cast("int")
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^\s*([-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+)\s*$"), 1)
    nodes = whole.select(F.col("_metadata.file_path").alias("path"), size.alias("size"), F.posexplode(lines).alias("at", "line")).withColumn("v", F.split(F.trim("line"), r"\s+"))
    at, n = F.col("at"), F.col("size")
    place = lambda c: c.cast("int")
    return nodes.select("path", "size", place(at % n).alias("ri"), place(F.floor(at / n) % n).alias("gi"), place(F.floor(at / (n * n))).alias("bi"), *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rgb")])


def write_cube(nodes: DataFrame, path: str, size: int, title: str = "") -> None:
    """A table (ri, gi, bi, vr, vg, vb) as one text file in the folder ``path``, red fastest; its size is bounded by that of the cube."""
    spark = nodes.sparkSession
    head = [f'TITLE "{title}"'] * bool(title) + [f"LUT_3D_SIZE {size}", "DOMAIN_MIN 0.0 0.0 0.0", "DOMAIN_MAX 1.0 1.0 1.0", ""]
    first = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "at long, value string")
    line = F.format_string("%.6f %.6f %.6f", "vr", "vg", "vb")
    rest = nodes.select(((F.col("bi") * size + F.col("gi")) * size + F.col("ri")).cast("long").alias("at"), line.alias("value"))
    first.unionByName(rest).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def unpack_vectors(df: DataFrame, blob: str, out: str) -> DataFrame:
    """Packed little-endian 32-bit floats as array<float>; bytes after the last whole number are left."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))

    return df.withColumn(out, decode(F.col(blob)))


def unpack_big_endian(df: DataFrame, blob: str, out: str, skip: int = 0) -> DataFrame:
    """Big-endian 64-bit floats after ``skip`` bytes, as in the lens blocks of raw files."""

    @F.pandas_udf("array<double>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield blobs.map(lambda b: None if b is None or len(b) < skip else np.frombuffer(b, ">f8", (len(b) - skip) // 8, skip).astype(float))

    return df.withColumn(out, decode(F.col(blob)))


WARP_SCHEMA = "planes int, coefficients array<array<double>>, cx double, cy double"
GAIN_SCHEMA = "rows int, cols int, planes int, row_pitch int, col_pitch int, data array<float>"


def opcodes(blob: bytes) -> Iterator[tuple[int, memoryview]]:
    """(id, parameters) of a big-endian list of correction steps; a step that is cut off ends the list."""
    raw = memoryview(blob)
    if len(raw) < 4:
        return
    at = 4
    for _ in range(int.from_bytes(raw[:4], "big")):
        if at + 16 > len(raw):
            return
        size = int.from_bytes(raw[at + 12 : at + 16], "big")
        if at + 16 + size <= len(raw):
            yield int.from_bytes(raw[at : at + 4], "big"), raw[at + 16 : at + 16 + size]
        at += 16 + size


def _warp(blob: bytes | None) -> dict | None:
    found = None
    for kind, body in opcodes(blob or b""):
        planes = int.from_bytes(body[:4], "big") if kind == 1 else 0
        if 1 <= planes <= 3 and len(body) >= 20 + 48 * planes:
            values = np.frombuffer(body, ">f8", 6 * planes + 2, 4).astype(float)
            found = {"planes": planes, "coefficients": values[:-2].reshape(planes, 6).tolist(), "cx": values[-2], "cy": values[-1]}
    return found


def _gain(blob: bytes | None) -> dict | None:
    found = None
    for kind, body in opcodes(blob or b""):
        if kind == 9 and len(body) >= 76:
            head = np.frombuffer(body, ">u4", 10, 0).astype(int).tolist()
            planes = int.from_bytes(body[72:76], "big")
            points = head[8] * head[9] * planes
            if 0 < points < 100_000 and 76 + 4 * points <= len(body):
                found = {"rows": head[8], "cols": head[9], "planes": planes, "row_pitch": head[6], "col_pitch": head[7], "data": np.frombuffer(body, ">f4", points, 76).astype(float).tolist()}
    return found


def unpack_opcodes(df: DataFrame, warp_blob: str, gain_blob: str, warp: str = "warp", gain: str = "gain") -> DataFrame:
    """Adds the rectilinear warp (step 1) of one list and the gain map (step 9) of another, null where there is none; of several the last counts."""

    @F.pandas_udf(WARP_SCHEMA)
    def warps(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_warp(b) or dict.fromkeys(("planes", "coefficients", "cx", "cy")) for b in blobs], columns=["planes", "coefficients", "cx", "cy"]).astype({"planes": "Int32"})

    @F.pandas_udf(GAIN_SCHEMA)
    def gains(blobs: pd.Series) -> pd.DataFrame:
        names = ["rows", "cols", "planes", "row_pitch", "col_pitch", "data"]
        return pd.DataFrame([_gain(b) or dict.fromkeys(names) for b in blobs], columns=names).astype(dict.fromkeys(names[:5], "Int32"))

    found = df.withColumns({warp: warps(F.col(warp_blob)), gain: gains(F.col(gain_blob))})
    return found.withColumns({c: F.when(F.col(f"{c}.planes").isNotNull(), F.col(c)) for c in (warp, gain)})


def maker_note_text(blob: bytes | None, tag: int) -> str:
    """The text of one tag of a maker note that is kept alone; '' if there is none."""
    return "" if blob is None else tags.note_text(bytes(blob), tag)


def with_maker_tag(df: DataFrame, blob: str, out: str, tag: int = 0x003D) -> DataFrame:
    """Adds a text tag of the maker note, by default the colour mode."""

    @F.pandas_udf("string")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: maker_note_text(b, tag))

    return df.withColumn(out, read(F.col(blob)))


def read_exported(spark: SparkSession, path: str, names: list[str] | None = None, **options: str) -> dict[str, DataFrame]:
    """Tables of a foreign catalogue, read only: exported as CSV files with a header, one a table; or over JDBC where ``path`` is a jdbc: URL and ``names`` are given."""
    if path.startswith("jdbc:"):
        return {n: spark.read.format("jdbc").options(url=path, dbtable=n, **options).load() for n in names or []}
    if names is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect()  # one row a table
        names = sorted(r["path"].rsplit("/", 1)[-1].removesuffix(".csv") for r in files)
    return {n: spark.read.options(header=True, inferSchema=True, **options).csv(f"{path.rstrip('/')}/{n}.csv") for n in names}


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """(camera, style, path) of lookup tables kept as root/camera/style.cube."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cube").load(root).select("path")
    return found.select(text.file_name(text.parent_dir("path")).alias("camera"), text.stem("path").alias("style"), "path")


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A table's new version as a folder of its own; readers of the one before are not disturbed. Returns its path."""
    path = f"{root.rstrip('/')}/v{version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path
