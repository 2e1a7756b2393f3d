"""Tints and tone, lens tables, warps and crops, detector boxes, layouts, colour fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import color, optics, text
from tessera.operators import fitting, mutations, search
from tessera.session import table as T

from .catalogue import query
from .colors import X, Y, _poly
from .vectors import CENTRE, SCORED

K = "(1600 + event_id % 30000)::DOUBLE"


@query("xy_kelvin", "WITH e AS (SELECT event_id, (event_id % 400) / 1000::DOUBLE + 0.25 AS x, (event_id % 300) / 1000::DOUBLE + 0.25 AS y FROM events), n AS (SELECT event_id, (x - 0.3320) / (y - 0.1858) AS n FROM e) SELECT event_id, round(449::DOUBLE * n * n * n + 3525::DOUBLE * n * n + 6823.3::DOUBLE * n + 5520.33, 3) AS kelvin FROM n")
def xy_kelvin(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return T(spark, sf, "events").select("event_id", F.round(color.xy_kelvin((k % 400) / F.lit(1000.0) + 0.25, (k % 300) / F.lit(1000.0) + 0.25), 3).alias("kelvin"))


SLOPE = f"CASE WHEN k BETWEEN 1667 AND 2222 THEN {_poly('x', *color.SLOPE_LOW)} WHEN k > 2222 AND k <= 4000 THEN {_poly('x', *color.SLOPE_MID)} ELSE {_poly('x', *color.SLOPE_HIGH)} END"


@query("tint_offset", f"WITH e AS (SELECT event_id, {K} AS k, (event_id % 41 - 20)::DOUBLE AS t FROM events), a AS (SELECT *, {X} AS x FROM e), b AS (SELECT *, {Y} AS y, {SLOPE} AS d FROM a) SELECT event_id, round(x + CASE WHEN t = 0 THEN 0 ELSE -t / 3000 * d / sqrt(1 + d * d) END, 7) AS x, round(y - CASE WHEN t = 0 THEN 0 ELSE -t / 3000 / sqrt(1 + d * d) END, 7) AS y FROM b")
def tint_offset(spark: SparkSession, sf: str) -> DataFrame:
    k, t = (F.lit(1600) + F.col("event_id") % 30000).cast("double"), (F.col("event_id") % 41 - 20).cast("double")
    x = color.kelvin_x(k)
    moved = color.tinted(k, t, x, color.kelvin_y(k))
    return T(spark, sf, "events").select("event_id", *[F.round(c, 7).alias(n) for c, n in zip(moved, "xy", strict=True)])


LUM = "(0.2126::DOUBLE * {0}r + 0.7152::DOUBLE * {0}g + 0.0722::DOUBLE * {0}b)"
STEP = "(least(greatest(({x} - {a}) / ({b} - {a}), 0), 1))"


def _smooth(x: str, a: float, b: float) -> str:
    t = STEP.format(x=x, a=f"{a!r}::DOUBLE", b=f"{b!r}::DOUBLE")
    return f"({t} * {t} * (3 - 2 * {t}))"


def _each(pattern: str) -> str:
    return ", ".join(f"{pattern.format(c=c)} AS {c}" for c in "rgb")


TONE = f"""
WITH e AS (SELECT event_id, (event_id % 97) / 97::DOUBLE AS r, (event_id % 89) / 89::DOUBLE AS g, (event_id % 83) / 83::DOUBLE AS b, (event_id % 9 - 4) / 4::DOUBLE AS ev, (event_id % 5 - 2) * 20 / 100::DOUBLE AS con,
  (event_id % 7 - 3) * 20 / 100::DOUBLE AS bla, (event_id % 3 - 1) * 30 / 100::DOUBLE AS whi, (event_id % 11 - 5) * 15 / 100::DOUBLE AS hig, (event_id % 13 - 6) * 12 / 100::DOUBLE AS sha, (event_id % 4 - 1) * 20 / 100::DOUBLE AS sat, (event_id % 6 - 2) * 25 / 100::DOUBLE AS vib FROM events),
a AS (SELECT * REPLACE (pow(r, 2.2::DOUBLE) * pow(2, ev) * 1.1::DOUBLE AS r, pow(g, 2.2::DOUBLE) * pow(2, ev) AS g, pow(b, 2.2::DOUBLE) * pow(2, ev) * 0.9::DOUBLE AS b) FROM e),
c AS (SELECT * REPLACE ({_each("CASE WHEN con <> 0 THEN 0.18::DOUBLE * pow(greatest({c}, 0.00001::DOUBLE) / 0.18::DOUBLE, 1 + con * 1.5::DOUBLE) ELSE {c} END")}) FROM a),
d AS (SELECT * REPLACE ({_each("CASE WHEN bla < 0 THEN greatest(({c} + bla * 0.06::DOUBLE) / (1 + bla * 0.06::DOUBLE), 0) WHEN bla > 0 THEN {c} * (1 - bla * 0.06::DOUBLE) + bla * 0.06::DOUBLE ELSE {c} END")}) FROM c),
f AS (SELECT * REPLACE ({_each("CASE WHEN whi > 0 THEN {c} / (1 - whi * 0.06::DOUBLE) ELSE {c} * (1 + whi * 0.06::DOUBLE) END")}) FROM d),
l AS (SELECT *, {LUM.format('')} AS l, least(greatest({LUM.format('')}, 0), 1) AS z FROM f),
j AS (SELECT *, hig * 0.25::DOUBLE * {_smooth('z', 0.55, 0.90)} + sha * 0.30::DOUBLE * {_smooth('z', 0.02, 0.08)} * (1 - {_smooth('z', 0.20, 0.40)}) AS adj, {_smooth('l', 0.02, 0.10)} AS mix FROM l),
k AS (SELECT * REPLACE ({_each("CASE WHEN adj <> 0 THEN greatest({c} + adj, 0) + ((CASE WHEN l > 0.0001 THEN {c} * (greatest(l + adj, 0) / l) ELSE greatest({c} + adj, 0) END) - greatest({c} + adj, 0)) * mix ELSE {c} END")}) FROM j),
m AS (SELECT * REPLACE ({_each("pow(greatest({c}, 0), 1 / 2.2::DOUBLE)")}) FROM k),
n AS (SELECT *, {LUM.format('')} AS gray FROM m),
o AS (SELECT * REPLACE ({_each("gray + ({c} - gray) * (1 + sat)")}) FROM n),
p AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS ran FROM o),
q AS (SELECT *, abs((CASE WHEN ran <= 0.001 THEN 0 WHEN top = r THEN (g - b) / ran - 6 * floor((g - b) / ran / 6) WHEN top = g THEN (b - r) / ran + 2 ELSE (r - g) / ran + 4 END) / 6 - 0.055::DOUBLE) AS off FROM p),
s AS (SELECT *, CASE WHEN ran > 0.001 THEN 1 - 0.6::DOUBLE * exp(-pow(least(off, 1 - off), 2) / (2 * 0.042::DOUBLE * 0.042::DOUBLE)) ELSE 1 END AS skin, pow(1 - CASE WHEN top > 0.001 THEN ran / top ELSE 0 END, 1.5::DOUBLE) AS pale FROM q)
SELECT event_id, {", ".join(f"round(CASE WHEN vib <> 0 THEN gray + ({c} - gray) * (1 + vib * pale * skin) ELSE {c} END, 5) + 0.0 AS {c}" for c in "rgb")} FROM s"""


@query("tone_pipeline", TONE)
def tone_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    pixels = T(spark, sf, "events").select("event_id", *[((k % n) / F.lit(float(n))).alias(c) for c, n in zip("rgb", (97, 89, 83), strict=True)])
    settings = {
        "exposure": (k % 9 - 4) / F.lit(4.0), "wb_r": F.lit(1.1), "wb_b": F.lit(0.9), "contrast": (k % 5 - 2) * 20, "blacks": (k % 7 - 3) * 20, "whites": (k % 3 - 1) * 30, "highlights": (k % 11 - 5) * 15,
        "shadows": (k % 13 - 6) * 12, "saturation": (k % 4 - 1) * 20, "vibrance": (k % 6 - 2) * 25,
    }
    return color.with_tone(pixels, ("r", "g", "b"), settings).select("event_id", *[(F.round(f"out_{c}", 5) + 0.0).alias(c) for c in "rgb"])


@query("url_encode", "SELECT page_id, url_encode(url || ' é*~+字') AS encoded FROM pages")
def url_encode(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").select("page_id", text.url_encoded(F.concat("url", F.lit(" é*~+字"))).alias("encoded"))


@query("golden_layout", f"""
WITH {SCORED}, t AS (SELECT vec_id, s.score, row_number() OVER (ORDER BY s.score DESC, vec_id) - 1 AS i FROM s ORDER BY s.score DESC, vec_id LIMIT 20),
p AS (SELECT vec_id, i, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 0.01) AS n FROM t),
d AS (SELECT vec_id, i, 270 + (1 - n * n) * 200 AS d, {optics.FIRST!r}::DOUBLE + i * {optics.GOLDEN!r}::DOUBLE AS a FROM p)
SELECT vec_id, round(cos(a) * d, 4) AS x, round(sin(a) * d, 4) AS y FROM d""")
def golden_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each of the 20 rows most similar to one: a report of the top, so one small window."""
    top = search.top_similar(T(spark, sf, "embeddings"), "vec_id", "embedding", CENTRE, 20)
    whole = Window.orderBy(F.desc("score"), "vec_id")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min("score").over(every), F.max("score").over(every)
    placed = top.select("vec_id", ((F.col("score") - low) / F.greatest(high - low, F.lit(0.01))).alias("n"), (F.row_number().over(whole) - 1).alias("i"))
    x, y = optics.golden_place(F.col("n"), F.col("i"))
    return placed.select("vec_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("anchor_decode", "WITH e AS (SELECT event_id, [8, 16, 32][(event_id % 3 + 1)::INT] AS s, event_id % 20 AS ax, event_id % 17 AS ay, (event_id % 5 + 1) / 4::DOUBLE AS p, (event_id % 7 + 1) / 4::DOUBLE AS q FROM events) SELECT event_id, ax * s - p * s AS x, ay * s - q * s AS y, p * s + 2 * q * s AS w, q * s + p / 2 * s AS h, ax * s + p * s AS kx, ay * s - q * s AS ky FROM e")
def anchor_decode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    p, q = (k % 5 + 1) / F.lit(4.0), (k % 7 + 1) / F.lit(4.0)
    raw = T(spark, sf, "events").select("event_id", F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (k % 3 + 1).cast("int")).alias("s"), (k % 20).alias("ax"), (k % 17).alias("ay"), F.array(p, q, 2 * q, p / 2).alias("sides"), F.array(p, -q).alias("offsets"))
    cx, cy = F.col("ax") * F.col("s"), F.col("ay") * F.col("s")
    box = optics.decoded_box(cx, cy, F.col("s"), F.col("sides"))
    mark = F.get(optics.decoded_points(cx, cy, F.col("s"), F.col("offsets")), F.lit(0))
    return raw.select("event_id", *[c.alias(n) for c, n in zip(box, "xywh", strict=True)], mark["x"].alias("kx"), mark["y"].alias("ky"))


@query("merge_persons", "SELECT 'orders' AS tbl, o_orderkey AS id, CASE WHEN o_custkey = 7 THEN 3 ELSE o_custkey END AS owner FROM orders UNION ALL SELECT 'customer', c_custkey, c_custkey FROM customer WHERE c_custkey <> 7")
def merge_persons(spark: SparkSession, sf: str) -> DataFrame:
    rows, persons = mutations.merge_persons(T(spark, sf, "orders").select("o_orderkey", "o_custkey"), T(spark, sf, "customer").select("c_custkey"), "o_custkey", "c_custkey", 3, 7)
    return rows.select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner")).union(persons.select(F.lit("customer"), "c_custkey", "c_custkey"))


@query("rename_unique", "SELECT c_custkey, 1 AS turn, c_name, false AS renamed FROM customer UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey = 8 THEN 'Zed' ELSE c_name END, c_custkey = 8 FROM customer")
def rename_unique(spark: SparkSession, sf: str) -> DataFrame:
    """First to a name that another row has, then to a new one."""
    people = T(spark, sf, "customer").select("c_custkey", "c_name")
    taken = people.where("c_custkey = 9").first()["c_name"]
    turns = [mutations.rename_unique(people, "c_custkey", "c_name", which, name).withColumn("turn", F.lit(i)) for i, which, name in ((1, 7, taken), (2, 8, "Zed"))]
    return turns[0].unionByName(turns[1])


@query("insert_valid", "WITH n AS (SELECT o_custkey + 700 AS id, o_orderstatus AS s FROM orders) SELECT (SELECT count(*) FROM n) AS offered, (SELECT count(DISTINCT id) FROM n WHERE s = 'F' AND id NOT IN (SELECT c_custkey FROM customer)) AS inserted, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT id FROM n WHERE s = 'F')) AS total")
def insert_valid(spark: SparkSession, sf: str) -> DataFrame:
    old = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("F").alias("s"))
    new = T(spark, sf, "orders").select((F.col("o_custkey") + 700).alias("id"), F.col("o_orderstatus").alias("s"))
    whole, counts = mutations.insert_valid(old, new, ["id"], F.col("s") == "F")
    return counts.crossJoin(F.broadcast(whole.agg(F.count("*").alias("total"))))


@query("crop_scale", """
WITH p AS (SELECT p_partkey, 3000 + p_size AS sw, 2000 + p_size AS sh, CASE WHEN p_partkey % 3 = 0 THEN 3100 ELSE 0 END AS iw, CASE WHEN p_partkey % 3 = 0 THEN 2100 ELSE 0 END AS ih, p_partkey % 40 AS x, p_partkey % 30 AS y FROM part),
s AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 AND sw <> iw THEN sw / iw::DOUBLE WHEN iw = 0 AND (x + 2990 > sw OR y + 1990 > sh) THEN sw / (2990 + 2 * x)::DOUBLE ELSE 1 END AS fx, CASE WHEN iw > 0 AND ih > 0 AND sw <> iw THEN sh / ih::DOUBLE WHEN iw = 0 AND (x + 2990 > sw OR y + 1990 > sh) THEN sh / (1990 + 2 * y)::DOUBLE ELSE 1 END AS fy FROM p),
o AS (SELECT *, greatest(1, floor(2990 * fx + 0.5)) AS w, greatest(1, floor(1990 * fy + 0.5)) AS h FROM s)
SELECT p_partkey, w::BIGINT AS w, h::BIGINT AS h, round(x * fx + (w - 1) * 0.5, 4) AS cx, round(y * fy + (h - 1) * 0.5, 4) AS cy FROM o""")
def crop_scale(spark: SparkSession, sf: str) -> DataFrame:
    k, known = F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    sw, sh, x, y = F.lit(3000) + F.col("p_size"), F.lit(2000) + F.col("p_size"), k % 40, k % 30
    fx, fy = optics.crop_scale(sw, sh, F.when(known, 3100).otherwise(0), F.when(known, 2100).otherwise(0), x, y, F.lit(2990), F.lit(1990))
    (w, cx), (h, cy) = optics.crop_centre(sw, x, F.lit(2990), fx), optics.crop_centre(sh, y, F.lit(1990), fy)
    return T(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"), F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


WARP = {"width": "width", "height": "height", "angle": "angle", "shear": "shear", "tilt_v": "tv", "tilt_h": "th", "focal": "focal"}
WARP_SQL = "w AS (SELECT p_partkey, 600 AS width, 400 AS height, (p_partkey % 13 - 6) / 20::DOUBLE AS angle, (p_partkey % 5 - 2) / 20::DOUBLE AS shear, (p_partkey % 7 - 3) * 3::DOUBLE AS tv, (p_partkey % 11 - 5) * 2::DOUBLE AS th, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 20 + p_partkey % 60 END AS focal FROM part), f AS (SELECT *, (CASE WHEN focal > 0 THEN focal ELSE 28 END) / 36::DOUBLE AS fx, (CASE WHEN focal > 0 THEN focal ELSE 28 END) / 24::DOUBLE AS fy FROM w)"


def _warps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return T(spark, sf, "part").select(
        "p_partkey", F.lit(600).alias("width"), F.lit(400).alias("height"), ((k % 13 - 6) / F.lit(20.0)).alias("angle"), ((k % 5 - 2) / F.lit(20.0)).alias("shear"),
        ((k % 7 - 3) * 3).cast("double").alias("tv"), ((k % 11 - 5) * 2).cast("double").alias("th"), F.when(k % 4 == 0, 0).otherwise(k % 60 + 20).alias("focal"),
    )


FORWARD = "s AS (SELECT *, u + shear * (v - 0.5) AS u2, cos(radians(th)) * ((u + shear * (v - 0.5)) - 0.5) / fx + sin(radians(th)) AS x1, (v - 0.5) / fy AS y1, cos(radians(th)) - sin(radians(th)) * ((u + shear * (v - 0.5)) - 0.5) / fx AS z1 FROM g), z AS (SELECT *, greatest(sin(radians(tv)) * y1 + cos(radians(tv)) * z1, 0.001) AS d FROM s), m AS (SELECT *, CASE WHEN tv = 0 AND th = 0 THEN u2 ELSE fx * x1 / d + 0.5 END AS wu, CASE WHEN tv = 0 AND th = 0 THEN v ELSE fy * (cos(radians(tv)) * y1 - sin(radians(tv)) * z1) / d + 0.5 END AS wv FROM z)"


@query("warp_roundtrip", f"WITH {WARP_SQL}, g AS (SELECT *, (p_partkey % 9) / 8::DOUBLE AS u, (p_partkey % 6) / 5::DOUBLE AS v FROM f), {FORWARD} SELECT p_partkey, round(wu, 6) AS wu, round(wv, 6) + 0.0 AS wv, round(u, 6) AS u, round(v, 6) AS v FROM m")
def warp_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Points forward, and back: the inverse gives the point again."""
    k = F.col("p_partkey")
    points = _warps(spark, sf).withColumns({"u": (k % 9) / F.lit(8.0), "v": (k % 6) / F.lit(5.0)})
    own = [F.col(c) for c in ("shear", "tv", "th", "focal")]
    wu, wv = optics.forward_warp(F.col("u"), F.col("v"), *own)
    there = points.withColumns({"wu": wu, "wv": wv})
    u, v = optics.inverse_warp(F.col("wu"), F.col("wv"), *own)
    return there.select("p_partkey", F.round("wu", 6).alias("wu"), (F.round("wv", 6) + 0.0).alias("wv"), F.abs(F.round(u, 6)).alias("u"), F.abs(F.round(v, 6)).alias("v"))


@query("warped_bbox", f"WITH {WARP_SQL}, g AS (SELECT f.*, u, v FROM f, (VALUES {', '.join(f'({u}::DOUBLE, {v}::DOUBLE)' for u, v in optics.PROBES)}) t(u, v)), {FORWARD}, r AS (SELECT p_partkey, (wu - 0.5) * width * cos(angle) - (wv - 0.5) * height * sin(angle) AS x, (wu - 0.5) * width * sin(angle) + (wv - 0.5) * height * cos(angle) AS y FROM m) SELECT p_partkey, round(max(x) - min(x), 3) AS w, round(max(y) - min(y), 3) AS h, greatest(1, floor(0.5 * (max(x) - min(x)) + 0.5))::BIGINT AS out_w, greatest(1, floor(0.25 * (max(y) - min(y)) + 0.5))::BIGINT AS out_h FROM r GROUP BY 1")
def warped_bbox(spark: SparkSession, sf: str) -> DataFrame:
    boxed = optics.with_warped_size(_warps(spark, sf), **WARP)
    out_w, out_h = optics.crop_output(F.lit(0.5), F.lit(0.25), F.col("box_w"), F.col("box_h"))
    return boxed.select("p_partkey", F.round("box_w", 3).alias("w"), F.round("box_h", 3).alias("h"), out_w.alias("out_w"), out_h.alias("out_h"))


@query("crop_quad", """
WITH w AS (SELECT p_partkey, (p_partkey % 13 - 6) / 20::DOUBLE AS a, (p_partkey % 10) / 40::DOUBLE AS x, (p_partkey % 8) / 40::DOUBLE AS y FROM part),
b AS (SELECT *, 600 * abs(cos(a)) + 400 * abs(sin(a)) AS bw, 600 * abs(sin(a)) + 400 * abs(cos(a)) AS bh FROM w),
c AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM b), d AS (SELECT *, (x + CASE WHEN i IN (1, 2) THEN 0.5 ELSE 0 END - 0.5) * bw AS dx, (y + CASE WHEN i IN (2, 3) THEN 0.5 ELSE 0 END - 0.5) * bh AS dy FROM c)
SELECT p_partkey, i::INT AS corner, round((dx * cos(-a) - dy * sin(-a)) / 600 + 0.5, 6) + 0.0 AS u, round((dx * sin(-a) + dy * cos(-a)) / 400 + 0.5, 6) + 0.0 AS v FROM d""")
def crop_quad(spark: SparkSession, sf: str) -> DataFrame:
    """Crops of turned images without perspective; with it the quad is checked in the tests by the way back."""
    k = F.col("p_partkey")
    plain = _warps(spark, sf).withColumns({"shear": F.lit(0.0), "tv": F.lit(0.0), "th": F.lit(0.0), "x": (k % 10) / F.lit(40.0), "y": (k % 8) / F.lit(40.0), "w": F.lit(0.5), "h": F.lit(0.5)})
    quads = optics.with_warped_size(plain, **WARP).withColumn("quad", optics.crop_quad(("x", "y", "w", "h"), **WARP))
    return quads.select("p_partkey", F.posexplode("quad").alias("corner", "p")).select("p_partkey", "corner", (F.round("p.u", 6) + 0.0).alias("u"), (F.round("p.v", 6) + 0.0).alias("v"))


@query("face_similarity", f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x}::DOUBLE, {y}::DOUBLE)' for i, (x, y) in enumerate(optics.FACE_TEMPLATE))}) t(i, dx, dy)),
p AS (SELECT p_partkey, i, dx, dy, dx * (1 + (p_partkey % 5) / 4::DOUBLE) + (p_partkey % 7) * (i % 2) + p_partkey % 30 AS sx, dy * (1 + (p_partkey % 5) / 4::DOUBLE) - (p_partkey % 3) * (i % 3) + p_partkey % 20 AS sy FROM part, t),
m AS (SELECT *, avg(sx) OVER w AS mx, avg(sy) OVER w AS my, avg(dx) OVER w AS ux, avg(dy) OVER w AS uy FROM p WINDOW w AS (PARTITION BY p_partkey)),
c AS (SELECT p_partkey, any_value(mx) AS mx, any_value(my) AS my, any_value(ux) AS ux, any_value(uy) AS uy, sum((dx - ux) * (sx - mx)) AS xx, sum((dx - ux) * (sy - my)) AS xy, sum((dy - uy) * (sx - mx)) AS yx, sum((dy - uy) * (sy - my)) AS yy, sum((sx - mx) * (sx - mx) + (sy - my) * (sy - my)) AS v FROM m GROUP BY 1),
a AS (SELECT *, atan2(xy - yx, xx + yy) AS th FROM c), s AS (SELECT *, (cos(th) * (xx + yy) + sin(th) * (yx - xy)) / v AS s FROM a)
SELECT p_partkey, round(s * cos(th), 5) AS a, round(s * sin(th), 5) + 0.0 AS b, round(ux - s * cos(th) * mx + s * sin(th) * my, 3) + 0.0 AS tx, round(uy - s * sin(th) * mx - s * cos(th) * my, 3) + 0.0 AS ty FROM s""")
def face_similarity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    grow = 1 + (k % 5) / F.lit(4.0)
    xs = F.array(*[F.lit(x) * grow + (k % 7) * (i % 2) + k % 30 for i, (x, _) in enumerate(optics.FACE_TEMPLATE)])
    ys = F.array(*[F.lit(y) * grow - (k % 3) * (i % 3) + k % 20 for i, (_, y) in enumerate(optics.FACE_TEMPLATE)])
    faces = T(spark, sf, "part").select("p_partkey", xs.alias("xs"), ys.alias("ys"))
    found = faces.select("p_partkey", optics.similarity(F.col("xs"), F.col("ys")).alias("m"))
    return found.select("p_partkey", *[(F.round(f"m.{c}", digits) + 0.0).alias(c) for c, digits in (("a", 5), ("b", 5), ("tx", 3), ("ty", 3))])


def _lenses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("double")
    values = lambda base, slope: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.lit(base) + slope * i * (k % 7) / 1000.0)
    tca = F.col("s_suppkey") % 3 != 0
    return T(spark, sf, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0)).alias("knots"), values(1.0, -1.0).alias("distortion"), F.when(tca, values(1.0, 0.1)).alias("red"), F.when(tca, values(1.0, -0.1)).alias("blue"), values(1.0, -10.0).alias("vignetting"))


LENS = "l AS (SELECT s_suppkey, (s_suppkey % 7) / 1000::DOUBLE AS q, s_suppkey % 3 <> 0 AS tca FROM supplier)"


@query("distortion_lut", f"WITH {LENS}, i AS (SELECT *, unnest(range(0, 512)) AS i FROM l), d AS (SELECT *, 1 - q * 10 * i / 511::DOUBLE AS g FROM i) SELECT s_suppkey, i::INT AS i, round(CASE WHEN tca THEN g * (1 + 0.1 * q * 10 * i / 511::DOUBLE) ELSE g END, 6) AS r, round(g, 6) AS g, round(CASE WHEN tca THEN g * (1 - 0.1 * q * 10 * i / 511::DOUBLE) ELSE g END, 6) AS b FROM d")
def distortion_lut(spark: SparkSession, sf: str) -> DataFrame:
    """Knots on a line, so that the table is that line."""
    return optics.distortion_table(_lenses(spark, sf), "s_suppkey", "knots", "distortion", "red", "blue").select("s_suppkey", "i", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("vignetting_lut", f"WITH {LENS}, c AS (SELECT *, unnest(range(0, 64)) AS y FROM l), x AS (SELECT *, unnest(range(0, 64)) AS x FROM c), r AS (SELECT *, sqrt(pow((x + 0.5) / 64 * 5999 - 2999.5, 2) + pow((y + 0.5) / 64 * 3999 - 1999.5, 2)) / sqrt(pow(2999.5, 2) + pow(1999.5, 2)) AS r FROM x) SELECT s_suppkey, y::INT AS y, x::INT AS x, round(1 / greatest(1 - 10 * q * 10 * r, 0.01), 5) AS gain FROM r")
def vignetting_lut(spark: SparkSession, sf: str) -> DataFrame:
    lenses = _lenses(spark, sf).withColumns({"width": F.lit(6000), "height": F.lit(4000)})
    return optics.vignetting_map(lenses, "s_suppkey", "width", "height", "knots", "vignetting").select("s_suppkey", "y", "x", F.round("gain", 5).alias("gain"))


@query("auto_scale")
def auto_scale(spark: SparkSession, sf: str) -> DataFrame:
    """The bisection depends on its steps; the tests restate it."""
    sized = _lenses(spark, sf).withColumns({"src_w": F.lit(600), "src_h": F.lit(400), "out_w": F.lit(580), "out_h": F.lit(390), "crop_cx": F.lit(299.5), "crop_cy": F.lit(199.5)})
    grown = sized.withColumn("distortion", F.transform("distortion", lambda v: 2.0 - v))
    return optics.auto_scale(grown).select("s_suppkey", F.round("scale", 6).alias("scale"))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rgb = T(spark, sf, "events").select(*[((k % n) / F.lit(float(n))).alias(c) for c, n in zip("rgb", (97, 89, 83), strict=True)])
    return rgb.withColumns({"tr": 0.87178 * F.col("r") + 0.10811 * F.col("g") * F.col("b"), "tg": 0.9731 * F.col("g") - 0.21925 * F.col("g") * F.col("g") * F.col("r"), "tb": 0.51606 * F.col("b") + 0.40999 * F.col("b") * F.col("b")})


@query("polynomial_lut", "WITH a AS (SELECT unnest(range(0, 9)) AS i), g AS (SELECT x.i AS ri, y.i AS gi, z.i AS bi, x.i / 8::DOUBLE AS r, y.i / 8::DOUBLE AS g, z.i / 8::DOUBLE AS b FROM a x, a y, a z) SELECT ri::INT AS ri, gi::INT AS gi, bi::INT AS bi, round(0.87178 * r + 0.10811 * g * b, 3) + 0.0 AS vr, round(0.9731 * g - 0.21925 * g * g * r, 3) + 0.0 AS vg, round(0.51606 * b + 0.40999 * b * b, 3) + 0.0 AS vb FROM g")
def polynomial_lut(spark: SparkSession, sf: str) -> DataFrame:
    """Targets are polynomials of the sources, so that the fit must find them; the SQL has the polynomials themselves."""
    return fitting.polynomial_lut(_pixels(spark, sf), size=9).select("ri", "gi", "bi", *[(F.round(v, 3) + 0.0).alias(v) for v in ("vr", "vg", "vb")])


@query("ratio_lut")
def ratio_lut(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares with cut ratios; the tests restate it."""
    return fitting.ratio_lut(_pixels(spark, sf), size=9).select("ri", "gi", "bi", *[F.round(v, 4).alias(v) for v in ("vr", "vg", "vb")])
