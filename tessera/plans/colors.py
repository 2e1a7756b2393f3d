"""Colour, lens and coordinate kernels on numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color, text
from tessera.session import table as T

from .catalogue import query

K = "(1600 + event_id % 30000)::DOUBLE"
T_ = "least(greatest({0}, 1667), 25000)"


def _poly(x: str, *cs: float) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _xy(k: str) -> tuple[str, str]:
    t = T_.format(k)
    u = f"(1 / {t})"
    x = f"CASE WHEN {t} < 4000 THEN {_poly(u, -0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910)} WHEN {t} <= 7000 THEN {_poly(u, -4.6070e9, 2.9678e6, 0.09911e3, 0.244063)} ELSE {_poly(u, -2.0064e9, 1.9018e6, 0.24748e3, 0.237040)} END"
    y = f"CASE WHEN {t} <= 2222 THEN {_poly('x', -1.1063814, -1.34811020, 2.18555832, -0.20219683)} WHEN {t} < 4000 THEN {_poly('x', -0.9549476, -1.37418593, 2.09137015, -0.16748867)} ELSE {_poly('x', -3.0, 2.87, -0.275)} END"
    return x, y


X, Y = _xy("k")


def _kelvin():
    return (F.lit(1600) + F.col("event_id") % 30000).cast("double")


@query("kelvin_xy", f"WITH e AS (SELECT event_id, {K} AS k FROM events), x AS (SELECT event_id, k, {X} AS x FROM e) SELECT event_id, round(x, 7) AS x, round({Y}, 7) AS y FROM x")
def kelvin_xy(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").select("event_id", F.round(color.kelvin_x(_kelvin()), 7).alias("x"), F.round(color.kelvin_y(_kelvin()), 7).alias("y"))


def _wb_sql() -> str:
    times = lambda m, v: [f"({v[0]} * {r[0]!r}::DOUBLE + {v[1]} * {r[1]!r}::DOUBLE + {v[2]} * {r[2]!r}::DOUBLE)" for r in m]
    xyz = lambda p: (f"({p}x / {p}y)", "1::DOUBLE", f"((1 - {p}x - {p}y) / {p}y)")
    x, y = color.D65
    white = [f"{r[0] * x / y + r[1] + r[2] * (1 - x - y) / y!r}::DOUBLE" for r in color.BRADFORD]
    adapted = [f"({w} * {t} / {s})" for w, t, s in zip(white, times(color.BRADFORD, xyz("t")), times(color.BRADFORD, xyz("s")), strict=True)]
    lms = ", ".join(f"{a} AS l{i}" for i, a in enumerate(adapted))
    back = ", ".join(f"{a} AS m{i}" for i, a in enumerate(times(color.BRADFORD_INVERSE, ("l0", "l1", "l2"))))
    r, g, b = times(color.XYZ_TO_SRGB, ("m0", "m1", "m2"))
    slope = lambda p: f"CASE WHEN {p}k BETWEEN 1667 AND 2222 THEN {_poly(f'{p}x', *color.SLOPE_LOW)} WHEN {p}k > 2222 AND {p}k <= 4000 THEN {_poly(f'{p}x', *color.SLOPE_MID)} ELSE {_poly(f'{p}x', *color.SLOPE_HIGH)} END"
    moved = lambda p: f"{p}x + CASE WHEN {p}t = 0 THEN 0 ELSE -{p}t / 3000 * {p}d / sqrt(1 + {p}d * {p}d) END AS {p}x, {p}y - CASE WHEN {p}t = 0 THEN 0 ELSE -{p}t / 3000 / sqrt(1 + {p}d * {p}d) END AS {p}y"
    tx, ty = _xy("tk")
    sx, sy = _xy("sk")
    return f"""
WITH e AS (SELECT event_id, (2000 + event_id % 9000)::DOUBLE AS tk, (3000 + event_id % 5000)::DOUBLE AS sk, (event_id % 41 - 20)::DOUBLE AS tt, (event_id % 31 - 15)::DOUBLE AS st FROM events),
x AS (SELECT *, {tx} AS tx, {sx} AS sx FROM e), d AS (SELECT *, {ty.replace(' x ', ' tx ')} AS ty, {sy.replace(' x ', ' sx ')} AS sy, {slope("t")} AS td, {slope("s")} AS sd FROM x),
y AS (SELECT * REPLACE ({moved("t")}, {moved("s")}) FROM d),
l AS (SELECT event_id, {lms} FROM y), m AS (SELECT event_id, {back} FROM l) SELECT event_id, round({r} / {g}, 5) AS r, round({b} / {g}, 5) AS b FROM m"""


@query("wb_multiplier", _wb_sql())
def wb_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    found = color.with_wb(T(spark, sf, "events").select("event_id"), 2000 + k % 9000, 3000 + k % 5000, target_tint=(k % 41 - 20).cast("double"), as_shot_tint=(k % 31 - 15).cast("double"))
    return found.select("event_id", F.round("r", 5).alias("r"), F.round("b", 5).alias("b"))


def _interp_sql(x: str, xs: list[float], ys: list[float]) -> str:
    steps = " ".join(f"WHEN {x} <= {b!r} THEN {c!r}::DOUBLE + ({x} - {a!r}::DOUBLE) / {b - a!r}::DOUBLE * {d - c!r}::DOUBLE" for a, b, c, d in zip(xs, xs[1:], ys, ys[1:]))
    return f"CASE WHEN {x} <= {xs[0]!r} THEN {ys[0]!r}::DOUBLE {steps} ELSE {ys[-1]!r}::DOUBLE END"


TABLE = sorted((rg, float(k)) for k, rg in color.KELVIN_TABLE)


@query("table_inverse_lookup", f"WITH e AS (SELECT event_id, 1 / ((event_id % 300 + 20) / 100::DOUBLE) AS x FROM events) SELECT event_id, round({_interp_sql('x', [r for r, _ in TABLE], [k for _, k in TABLE])}, 3) AS kelvin FROM e")
def table_inverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    red = (F.col("event_id") % 300 + 20) / F.lit(100.0)
    return T(spark, sf, "events").select("event_id", F.round(color.kelvin_from_ratio(red, F.lit(1.0)), 3).alias("kelvin"))


@query("piecewise_linear", f"SELECT event_id, round({_interp_sql('value', [0.0, 10.0, 50.0, 200.0], [1.0, 0.9, 0.5, 0.25])}, 6) AS v FROM events")
def piecewise_linear(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").select("event_id", F.round(color.interpolate(F.col("value"), [0.0, 10.0, 50.0, 200.0], [1.0, 0.9, 0.5, 0.25]), 6).alias("v"))


@query("tone_curve", "WITH e AS (SELECT l_suppkey, l_discount * 5 AS v, l_tax * 10 AS ev, (l_quantity - 25)::DOUBLE AS c FROM lineitem), l AS (SELECT *, pow(v, 2.2) * pow(2, ev) AS lin FROM e) SELECT round(avg(pow(greatest(CASE WHEN c <> 0 THEN 0.18 * pow(greatest(lin, 0.00001) / 0.18, 1 + c / 100 * 1.5) ELSE lin END, 0), 1 / 2.2::DOUBLE)), 6) AS mean, l_suppkey FROM l GROUP BY l_suppkey")
def tone_curve(spark: SparkSession, sf: str) -> DataFrame:
    gray = T(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") * 5).alias("v"), "l_tax", "l_quantity")
    out = color.with_tone(gray, ("v", "v", "v"), {"exposure": F.col("l_tax") * 10, "contrast": F.col("l_quantity") - 25})
    return out.groupBy("l_suppkey").agg(F.round(F.avg("out_g"), 6).alias("mean"))


@query("ycbcr_roundtrip", "WITH e AS (SELECT event_id, (event_id % 7) / 7::DOUBLE AS r, (event_id % 11) / 11::DOUBLE AS g, (event_id % 13) / 13::DOUBLE AS b FROM events), y AS (SELECT event_id, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y, -0.169::DOUBLE * r - 0.331::DOUBLE * g + 0.5 * b AS cb, 0.5 * r - 0.419::DOUBLE * g - 0.081::DOUBLE * b AS cr FROM e) SELECT event_id, round(y, 6) AS y, round(y + 1.402 * cr, 6) + 0.0 AS r, round(y - 0.344 * cb - 0.714 * cr, 6) + 0.0 AS g, round(y + 1.772 * cb, 6) + 0.0 AS b FROM y")
def ycbcr_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    y, cb, cr = color.ycbcr((k % 7) / F.lit(7.0), (k % 11) / F.lit(11.0), (k % 13) / F.lit(13.0))
    r, g, b = color.rgb_of(y, cb, cr)
    return T(spark, sf, "events").select("event_id", F.round(y, 6).alias("y"), *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


@query("poly_features", "WITH e AS (SELECT event_id, (event_id % 7) / 7::DOUBLE AS r, (event_id % 11) / 11::DOUBLE AS g, (event_id % 13) / 13::DOUBLE AS b FROM events), s AS (SELECT *, r + g + b + 1e-6::DOUBLE AS s FROM e) SELECT event_id, round(r * r, 6) AS rr, round(r * g, 6) AS rg, round(r * b, 6) AS rb, round(g * g * b, 6) AS ggb, round(s / 3, 6) AS lum, round(r / s, 6) AS chroma_r, round(g / s, 6) AS chroma_g FROM s")
def poly_features(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = T(spark, sf, "events").select("event_id", ((k % 7) / F.lit(7.0)).alias("r"), ((k % 11) / F.lit(11.0)).alias("g"), ((k % 13) / F.lit(13.0)).alias("b"))
    terms = color.polynomial_terms(["r", "g", "b"], 3)
    lum, red, green = color.chromaticity(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("event_id", *[F.round(terms[t], 6).alias(t) for t in ("rr", "rg", "rb", "ggb")], F.round(lum, 6).alias("lum"), F.round(red, 6).alias("chroma_r"), F.round(green, 6).alias("chroma_g"))


@query("rotated_bbox", "SELECT event_id, round(600 * abs(cos(a)) + 400 * abs(sin(a)), 4) AS w, round(600 * abs(sin(a)) + 400 * abs(cos(a)), 4) AS h FROM (SELECT event_id, (event_id % 628) / 100::DOUBLE AS a FROM events)")
def rotated_bbox(spark: SparkSession, sf: str) -> DataFrame:
    w, h = color.rotated_size(F.lit(600.0), F.lit(400.0), (F.col("event_id") % 628) / F.lit(100.0))
    return T(spark, sf, "events").select("event_id", F.round(w, 4).alias("w"), F.round(h, 4).alias("h"))


@query("orient_remap", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN x WHEN 1 THEN round(1 - y - h, 6) ELSE y END AS x, CASE event_id % 3 WHEN 0 THEN y WHEN 1 THEN x ELSE round(1 - x - w, 6) END AS y FROM (SELECT event_id, (event_id % 50) / 100::DOUBLE AS x, (event_id % 30) / 100::DOUBLE AS y, 0.25::DOUBLE AS w, 0.5::DOUBLE AS h FROM events)")
def orient_remap(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    x, y = color.reoriented((k % 50) / F.lit(100.0), (k % 30) / F.lit(100.0), F.lit(0.25), F.lit(0.5), F.element_at(F.array(F.lit(1), F.lit(6), F.lit(8)), (k % 3 + 1).cast("int")))
    return T(spark, sf, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("fit_long_edge", "SELECT p_partkey, greatest(1, floor(w * s + 0.5))::BIGINT AS w, greatest(1, floor(h * s + 0.5))::BIGINT AS h FROM (SELECT *, CASE WHEN greatest(w, h) > 2048 THEN 2048::DOUBLE / greatest(w, h) ELSE 1 END AS s FROM (SELECT p_partkey, p_size * 100 AS w, (p_partkey % 3000 + 1) AS h FROM part))")
def fit_long_edge(spark: SparkSession, sf: str) -> DataFrame:
    w, h = color.fit_long_edge(F.col("p_size") * 100, F.col("p_partkey") % 3000 + 1, 2048)
    return T(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("radial_warp", "SELECT event_id, round(0.9::DOUBLE + 0.05::DOUBLE * q + 0.01::DOUBLE * q * q - 0.002::DOUBLE * q * q * q, 6) AS f FROM (SELECT event_id, pow((event_id % 100) / 100::DOUBLE, 2) AS q FROM events)")
def radial_warp(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "events").select("event_id", F.round(color.radial_warp((F.col("event_id") % 100) / F.lit(100.0), 0.9, 0.05, 0.01, -0.002), 6).alias("f"))


@query("array_fixed_point", "WITH e AS (SELECT event_id, unnest([0, 4096, (event_id % 8192)::INT]) AS v, generate_subscripts([1, 2, 3], 1) AS pos FROM events) SELECT event_id, pos, round(v / 16384::DOUBLE + 1, 7) AS distortion, round(v / 2097152::DOUBLE + 1, 9) AS aberration, round(pow(2, 0.5 - pow(2, v / 8192::DOUBLE - 1)), 7) AS vignetting FROM e")
def array_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.array(F.lit(0), F.lit(4096), (F.col("event_id") % 8192).cast("int"))
    decoded = F.transform(raw, lambda v: F.struct(F.round(color.distortion_factor(v), 7).alias("distortion"), F.round(color.aberration_factor(v), 9).alias("aberration"), F.round(color.vignetting_gain(v), 7).alias("vignetting")))
    rows = T(spark, sf, "events").select("event_id", F.posexplode(decoded).alias("pos", "x"))
    return rows.select("event_id", (F.col("pos") + 1).cast("long").alias("pos"), "x.*")


@query("dms_to_decimal", "SELECT event_id, round((event_id % 90) + CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 60) / (event_id % 4)::DOUBLE / 60 END + (event_id % 600) / 10::DOUBLE / 3600, 7) AS degrees FROM events")
def dms_to_decimal(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    value = text.dms(k % 90, F.lit(1), k % 60, k % 4, k % 600, F.lit(10))
    return T(spark, sf, "events").select("event_id", F.round(value, 7).alias("degrees"))


@query("xmp_coord", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * ((event_id % 90) + (event_id % 59) / 60::DOUBLE), 6) + 0.0 END AS degrees FROM events")
def xmp_coord(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    shown = F.when(k % 5 == 0, "bad").otherwise(F.concat((k % 90).cast("string"), F.lit(","), (k % 59).cast("string"), F.when(k % 2 == 0, "S").otherwise("N")))
    return T(spark, sf, "events").select("event_id", (F.round(text.xmp_coordinate(shown), 6) + 0.0).alias("degrees"))


@query("rational_string", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN (event_id % 100)::DOUBLE ELSE round((event_id % 100) / (event_id % 4)::DOUBLE, 6) END AS v FROM events")
def rational_string(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    shown = F.when(k % 4 == 3, (k % 100).cast("string")).otherwise(F.concat_ws("/", (k % 100).cast("string"), (k % 4).cast("string")))
    return T(spark, sf, "events").select("event_id", F.round(text.rational(shown), 6).alias("v"))
