"""Media queries: shooting data of files, free names, lookup cubes, places by position and name."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions import color, cubes, optics
from tessera.operators import boxes, gazetteer, mutations
from tessera.session import table as T
from tessera.sources import tags
from tessera.workspace import spread

from .catalogue import query
from .common import gps_sql, with_gps


def tiff_file(order: str, image: list, exif: list, gps: list) -> bytes:
    """A file of three tag directories of entries (tag, kind, values), in either byte order; texts are bytes with their closing zero."""
    out, places = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)), {}
    for name, entries in (("image", image), ("exif", exif), ("gps", gps)):
        places[name] = len(out)
        start, far = len(out), bytearray()
        end = start + 2 + 12 * len(entries) + 4
        out += struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            code = tags.KINDS[kind]
            body = values if code == "s" else struct.pack(f"{order}{len(values)}{code[0]}", *values)
            n = len(body) // struct.calcsize(order + code)
            inline = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", end + len(far))
            far += b"" if len(body) <= 4 else body
            out += struct.pack(order + "HHI", tag, kind, n) + inline
        out += struct.pack(order + "I", 0) + far
    for tag, name in ((0x8769, "exif"), (0x8825, "gps")):
        at = out.find(struct.pack(order + "HHI", tag, 4, 1), 8)
        if at >= 0:
            struct.pack_into(order + "I", out, at + 8, places[name])
    return bytes(out)


@F.pandas_udf(BinaryType())
def _files(key: pd.Series, brand: pd.Series, name: pd.Series, kind: pd.Series, size: pd.Series, cents: pd.Series) -> pd.Series:
    """A file for each part: bytes in either order, every third inside a JPEG, every seventh cut short."""
    made = []
    for k, b, n, t, s, c in zip(key, brand, name, kind, size, cents, strict=True):
        text = lambda x: x.encode() + b"\0"
        image = [(0x010F, 2, text(b)), (0x0110, 2, text(n)), (0x0112, 3, [k % 8 + 1]), (0x8769, 4, [0]), (0x8825, 4, [0])]
        exif = [(0x829A, 5, [1, k % 500 + 2]), (0x8827, 3, [s * 100]), (0x9204, 10, [k % 7 - 3, 3]), (0x920A, 5, [c, 100]), (0xA002, 4, [k % 5000]), (0xA003, 3, [k % 4000]), (0xA403, 3, [k % 3]), (0xA434, 2, text(t))]
        gps = [(1, 2, b"S\0" if k % 2 else b"N\0"), (2, 5, [k % 90, 1, k % 60, 1, k % 3600, 100]), (3, 2, b"W\0" if k % 4 < 2 else b"E\0"), (4, 5, [k % 180, 1, 30, 1, 0, 1]), (5, 1, [k % 2]), (6, 5, [k % 9000, 10])]
        blob = tiff_file("<" if k % 2 else ">", image, exif, gps)
        if k % 3 == 0:
            blob = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(blob) + 8) + b"Exif\0\0" + blob + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 480, 640) + b"\x01\0\0\0\xff\xd9"
        made.append(blob[:13] if k % 7 == 3 else blob)
    return pd.Series(made)


@query("exif_tags", """
WITH p AS (SELECT *, p_partkey AS k, p_partkey % 7 <> 3 AS ok FROM part)
SELECT p_partkey, CASE WHEN ok THEN p_brand END AS make, CASE WHEN ok THEN p_name END AS model, CASE WHEN ok THEN p_type END AS lens, CASE WHEN ok THEN (k % 8 + 1)::INT END AS orientation,
  CASE WHEN ok THEN '1/' || (k % 500 + 2) END AS exposure_time, CASE WHEN ok THEN (p_size * 100)::DOUBLE END AS iso, CASE WHEN ok THEN round((k % 7 - 3) / 3::DOUBLE, 6) + 0.0 END AS exposure_bias,
  CASE WHEN ok THEN round(round(p_retailprice * 100) / 100, 6) END AS focal_length,
  CASE WHEN ok THEN CASE WHEN k % 5000 > 0 THEN k % 5000 WHEN k % 3 = 0 THEN 640 END END::INT AS width, CASE WHEN ok THEN CASE WHEN k % 4000 > 0 THEN k % 4000 WHEN k % 3 = 0 THEN 480 END END::INT AS height,
  CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Manual' ELSE '(2)' END END AS white_balance,
  CASE WHEN ok THEN round((k % 90 + (k % 60) / 60::DOUBLE + (k % 3600) / 100::DOUBLE / 3600) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END, 6) + 0.0 END AS latitude,
  CASE WHEN ok THEN round((k % 180 + 0.5::DOUBLE) * CASE WHEN k % 4 < 2 THEN -1 ELSE 1 END, 6) + 0.0 END AS longitude,
  CASE WHEN ok THEN round((k % 9000) / 10::DOUBLE * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END, 6) + 0.0 END AS altitude
FROM p""")
def exif_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Shooting data read back from the bytes of one file for each part."""
    parts = spread(T(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_retailprice"))
    files = parts.select("p_partkey", _files("p_partkey", "p_brand", "p_name", "p_type", "p_size", F.round(F.col("p_retailprice") * 100).cast("long")).alias("content"))
    told = tags.with_tags(files).select("p_partkey", "tags.*")
    near = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return told.select("p_partkey", F.col("camera_make").alias("make"), F.col("camera").alias("model"), "lens", "orientation", "exposure_time", "iso", near("exposure_bias"), near("focal_length"), "width", "height", "white_balance", near("latitude"), near("longitude"), near("altitude"))


@query("free_names", r"""
WITH a AS (SELECT p_partkey AS k, p_brand AS f, p_name || CASE WHEN p_partkey % 5 = 0 THEN '-2.jpg' ELSE '.jpg' END AS name FROM part),
t AS (SELECT DISTINCT p_brand AS f, p_name || '-' || (p_partkey % 4) || '.jpg' AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_brand, p_name || '.jpg' FROM part WHERE p_partkey % 11 = 0),
b AS (SELECT a.*, row_number() OVER (PARTITION BY f, name ORDER BY k) = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.f = a.f AND t.name = a.name) AS keeps, regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) AS stem FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY f, stem ORDER BY k) AS r FROM b WHERE NOT keeps),
u AS (SELECT f, name FROM t UNION SELECT f, name FROM b WHERE keeps),
n AS (SELECT f, stem, i, row_number() OVER (PARTITION BY f, stem ORDER BY i) AS r FROM (SELECT DISTINCT f, stem FROM w) g, (SELECT unnest(range(1, 60)) AS i) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.f = g.f AND u.name = g.stem || '-' || i || '.jpg'))
SELECT k AS p_partkey, name AS target FROM b WHERE keeps UNION ALL SELECT k, w.stem || '-' || n.i || '.jpg' FROM w JOIN n USING (f, stem, r)""")
def free_names(spark: SparkSession, sf: str) -> DataFrame:
    part = T(spark, sf, "part")
    number = F.when(F.col("p_partkey") % 5 == 0, "-2.jpg").otherwise(".jpg")
    asked = part.select("p_partkey", F.col("p_brand").alias("folder"), F.concat("p_name", number).alias("name"))
    listed = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("folder"), F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 4).cast("string"), F.lit(".jpg")).alias("name"))
    plain = part.where("p_partkey % 11 = 0").select(F.col("p_brand").alias("folder"), F.concat("p_name", F.lit(".jpg")).alias("name"))
    return mutations.free_names(asked, listed.union(plain), "folder", "name", "p_partkey").select("p_partkey", "target")


CUBE_SQL = """
WITH p AS (SELECT event_id, value / 250 - 0.1 AS r, (event_id % 89) / 88::DOUBLE AS g, (event_id % 83) / 82::DOUBLE AS b, user_id % 6 AS k, event_id % 4 = 0 AS vivid, 0.25 * (event_id % 5) AS s FROM events),
q AS (SELECT *, k < 5 AS has, vivid AND k % 2 = 0 AS v, CASE WHEN vivid AND k % 2 = 0 THEN 9 ELSE 4 + k END AS n FROM p),
c AS (SELECT *, least(1, greatest(0, r)) * (n - 1) AS pr, g * (n - 1) AS pg, b * (n - 1) AS pb FROM q),
d AS (SELECT *, least(floor(pr), n - 2) AS ir, least(floor(pg), n - 2) AS ig, least(floor(pb), n - 2) AS ib FROM c),
o AS (SELECT unnest([0, 1]) AS x), z AS (SELECT a.x AS x, b.x AS y, c.x AS w FROM o a, o b, o c),
e AS (SELECT d.*, (CASE WHEN x = 1 THEN pr - ir ELSE 1 - pr + ir END) * (CASE WHEN y = 1 THEN pg - ig ELSE 1 - pg + ig END) * (CASE WHEN w = 1 THEN pb - ib ELSE 1 - pb + ib END) AS f, (ir + x) / (n - 1) AS nr, (ig + y) / (n - 1) AS ng, (ib + w) / (n - 1) AS nb FROM d, z),
m AS (SELECT event_id, sum(f * nr * nr) AS lr, sum(f * ng * (1 - nb / 2)) AS lg, sum(f * CASE WHEN v THEN nb ELSE sqrt(nb) END) AS lb FROM e GROUP BY 1)
SELECT event_id, round(CASE WHEN has THEN r + (lr - r) * s ELSE r END, 6) + 0.0 AS out_r, round(CASE WHEN has THEN g + (lg - g) * s ELSE g END, 6) + 0.0 AS out_g, round(CASE WHEN has THEN b + (lb - b) * s ELSE b END, 6) + 0.0 AS out_b
FROM q JOIN m USING (event_id)
"""


@query("cube_lookup", CUBE_SQL)
def cube_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels through the cube of their camera and style, or else of their camera; a camera of its own style for every other region."""
    regions = T(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    plain = regions.select(F.concat(F.lit("cam"), "k").alias("profile"), (F.col("k") + 4).cast("int").alias("size"), F.lit(False).alias("vivid"))
    vivid = regions.where("k % 2 = 0").select(F.concat(F.lit("cam"), "k", F.lit("/vivid")).alias("profile"), F.lit(9).alias("size"), F.lit(True).alias("vivid"))
    nodes = plain.union(vivid)
    for c in ("ri", "gi", "bi"):
        nodes = nodes.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias(c))
    r, g, b = (F.col(c) / (F.col("size") - 1) for c in ("ri", "gi", "bi"))
    # the SQL's factors are kept apart and rounded as it does: results stand on halves of the last digit, where the last bit decides
    colour = {"r": r, "g": g, "b": F.when(F.col("vivid"), b).otherwise(F.sqrt(b)), "gr": r, "gg": 1 - b / 2, "gb": F.lit(1.0)}
    cells = cubes.cube_cells(nodes.select("profile", "size", "ri", "gi", "bi", *[v.alias(n) for n, v in colour.items()]), ["profile"], gains=("gr", "gg", "gb"))
    k = F.col("event_id")
    camera = F.concat(F.lit("cam"), (F.col("user_id") % 6).cast("string"))
    pixels = T(spark, sf, "events").select("event_id", (F.col("value") / 250 - 0.1).alias("r"), (k % 89 / 88.0).alias("g"), (k % 83 / 82.0).alias("b"), (k % 5 * 0.25).alias("share"), camera.alias("camera"), F.when(k % 4 == 0, F.concat(camera, F.lit("/vivid"))).alias("own"))
    known = plain.union(vivid).select("profile")
    told = pixels.join(known.select(F.col("profile").alias("own"), F.col("profile").alias("styled")), "own", "left").withColumn("profile", F.coalesce("styled", "camera")).drop("own", "styled", "camera")
    out = cubes.with_cube(told, cells, ["profile"], blend="share", gained=True)
    return out.select("event_id", *[(color.rounded(F.col(f"out_{c}"), 6) + 0.0).alias(f"out_{c}") for c in "rgb"])


@query("nearest_place", f"""
WITH e AS ({gps_sql('events', 'event_id')}), c AS ({gps_sql('customer', 'c_custkey')}),
p AS (SELECT DISTINCT lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM e WHERE event_id % 5 <> 4),
q AS (SELECT c_custkey, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM c WHERE c_custkey % 5 <> 4),
b AS (SELECT lat, lon, min((round((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z), 12), c_custkey)) AS b FROM p, q GROUP BY 1, 2)
SELECT event_id, b[2] AS c_custkey, round(2 * 6371.0::DOUBLE * asin(sqrt(b[1]) / 2), 3) AS km FROM e JOIN b USING (lat, lon) WHERE event_id % 5 <> 4""")
def nearest_place(spark: SparkSession, sf: str) -> DataFrame:
    points = with_gps(T(spark, sf, "events").select("event_id"), "event_id").where("event_id % 5 <> 4")
    places = with_gps(T(spark, sf, "customer").select("c_custkey"), "c_custkey").where("c_custkey % 5 <> 4")
    return gazetteer.nearest_place(points, places, "c_custkey", start_km=200.0).select("event_id", "c_custkey", F.round("km", 3).alias("km"))


@query("named_box", """
WITH s AS (SELECT s_suppkey, '  ' || CASE WHEN s_suppkey % 9 = 0 THEN 'nowhere' WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT n_name AS name, n_nationkey * 3.0::DOUBLE - 30 AS lat, n_nationkey * 7.0::DOUBLE - 80 AS lon, n_nationkey % 3 AS h FROM nation),
b AS (SELECT lower(name) AS key, CASE h WHEN 0 THEN lat - 0.05 WHEN 1 THEN lat - 1.5 ELSE lat - 0.05 END AS south, CASE h WHEN 0 THEN lat + 0.05 WHEN 1 THEN lat + 1.5 ELSE lat + 0.05 END AS north, CASE h WHEN 0 THEN lon - 0.05 WHEN 1 THEN lon - 2.5 ELSE lon - 0.05 END AS west, CASE h WHEN 0 THEN lon + 0.05 WHEN 1 THEN lon + 2.5 ELSE lon + 0.05 END AS east FROM p)
SELECT s_suppkey, round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east FROM s LEFT JOIN b ON key = lower(trim(name))""")
def named_box(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as places: a third without a box, a third with one, a third with one that is too small."""
    nation = T(spark, sf, "nation")
    k = F.col("n_nationkey")
    half = lambda large: F.when(k % 3 == 1, large).when(k % 3 == 2, 0.01)
    lat, lon = k * 3.0 - 30, k * 7.0 - 80
    places = nation.select(F.col("n_name").alias("name"), k.alias("rank"), lat.alias("lat"), lon.alias("lon"), (lat - half(1.5)).alias("south"), (lat + half(1.5)).alias("north"), (lon - half(2.5)).alias("west"), (lon + half(2.5)).alias("east"))
    worse = places.withColumn("rank", F.col("rank") + 1000).withColumn("south", F.lit(-90.0))
    named = T(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.when(F.col("s_suppkey") % 9 == 0, "nowhere").when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    found = gazetteer.named_box(named.select("s_suppkey", F.concat(F.lit("  "), name).alias("name")), places.union(worse))
    return found.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query("box_mean_var_2d", """
WITH p AS (SELECT event_id // 5000 AS i, (event_id % 5000) % 71 AS x, (event_id % 5000) // 71 AS y, value::DOUBLE AS v FROM events),
d AS (SELECT unnest(range(-3, 4)) AS d), b AS (SELECT i, x + a.d AS x, y + b.d AS y, v FROM p, d a, d b),
s AS (SELECT i, x, y, count(*) AS n, avg(v) AS mean, greatest(avg(v * v) - avg(v) * avg(v), 0) AS var FROM b GROUP BY 1, 2, 3)
SELECT i AS image, x, y, n, round(mean, 6) AS mean, round(var, 3) + 0.0 AS variance, round(mean + greatest(0, (var - 900) / greatest(var, 1e-10)) * (v - mean), 4) AS smooth FROM p JOIN s USING (i, x, y)""")
def box_mean_var_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of 7 by 7 over images of 71 columns."""
    k = F.col("event_id")
    pixels = T(spark, sf, "events").select(F.floor(k / 5000).alias("image"), (k % 5000 % 71).alias("x"), F.floor(k % 5000 / 71).alias("y"), "value")
    found = boxes.box_stats(pixels, radius=3, tile=32)
    smooth = boxes.smoothed(F.col("value"), F.col("mean"), F.col("variance"), 900.0)
    return found.select("image", "x", "y", "n", F.round("mean", 6).alias("mean"), (F.round("variance", 3) + 0.0).alias("variance"), F.round(smooth, 4).alias("smooth"))


@query("gain_map", """
WITH p AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_suppkey % 7 AS s, (l_partkey % 600)::DOUBLE AS x, (l_orderkey % 400)::DOUBLE AS y, l_discount * 9 AS v FROM lineitem),
q AS (SELECT *, x / 599 * 4 AS gx, y / 399 * (2 + s % 2) AS gy, least(floor(x / 599 * 4), 3) AS c, least(floor(y / 399 * (2 + s % 2)), 1 + s % 2) AS r FROM p),
o AS (SELECT unnest([0, 1]) AS o),
g AS (SELECT q.*, (CASE WHEN a.o = 1 THEN gx - c ELSE 1 - gx + c END) * (CASE WHEN b.o = 1 THEN gy - r ELSE 1 - gy + r END) * (1 + (((r + b.o) * 5 + c + a.o) * 3 + 1) * 0.0625 * (s + 1) / 7) AS w FROM q, o a, o b),
m AS (SELECT id, l_orderkey, l_linenumber, s, v, sum(w) AS gain FROM g GROUP BY ALL),
z AS (SELECT *, (CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) * gain AS lin FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN s < 6 THEN round(gain, 6) END AS gain, CASE WHEN s < 6 THEN round(least(1, greatest(0, CASE WHEN lin <= 0.0031308 THEN lin * 12.92 ELSE 1.055 * pow(lin, 1 / 2.4::DOUBLE) - 0.055 END)), 6) + 0.0 END AS lit FROM z""")
def gain_map(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pixels under the gain map of their supplier, one of six; the seventh has none."""
    s = F.col("l_suppkey") % 7
    rows = (F.lit(3) + s % 2).cast("int")
    data = F.transform(F.sequence(F.lit(0), rows * 15 - 1), lambda i: 1 + i * 0.0625 * (s + 1) / 7)
    gain = F.when(s < 6, F.struct(rows.alias("rows"), F.lit(5).alias("cols"), F.lit(3).alias("planes"), data.alias("data")))
    told = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 9).alias("v"), (F.col("l_partkey") % 600).alias("x"), (F.col("l_orderkey") % 400).alias("y"), gain.alias("gain"))
    found = told.select("l_orderkey", "l_linenumber", "v", optics.gain_at(F.col("gain"), F.col("x"), F.col("y"), F.lit(600), F.lit(400), 1).alias("gain"))
    lit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), optics.from_linear(optics.to_linear(F.col("v")) * F.col("gain"))))
    return found.select("l_orderkey", "l_linenumber", F.round("gain", 6).alias("gain"), F.when(F.col("gain").isNotNull(), F.round(lit, 6) + 0.0).alias("lit"))


@query("radial_inverse", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE round((event_id % 1201) / 1000::DOUBLE, 6) END AS r FROM events")
def radial_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Radii sent through a lens polynomial and back."""
    grown = lambda r: r * color.radial_warp(r, 0.98, 0.07, -0.011, 0.002)
    r = F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 1201 / 1000)
    return T(spark, sf, "events").select("event_id", grown(r).alias("t")).select("event_id", F.round(optics.inverse_of(grown, F.col("t"), 1.5), 6).alias("r"))
