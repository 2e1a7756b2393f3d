"""Colour and lens kernels as Column arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bradford matrix and its inverse, XYZ to linear sRGB, D65, luminance weights.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.9870, -0.1471, 0.1600), (0.4323, 0.5184, 0.0493), (-0.0085, 0.0400, 0.9685))
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
D65 = (0.31271, 0.32902)
LUMA = (0.2126, 0.7152, 0.0722)
#: Coefficients of the daylight locus (from 4000 K, from 7000 K) and the Planckian one by powers of the inverse temperature,
#: of y by powers of x below 2222 K, below 4000 K and above, and of a temperature by powers of McCamy's ratio.
PLANCK_X = (-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910)
DAYLIGHT_X = (-4.6070e9, 2.9678e6, 0.09911e3, 0.244063)
COOL_X = (-2.0064e9, 1.9018e6, 0.24748e3, 0.237040)
PLANCK_Y_LOW = (-1.1063814, -1.34811020, 2.18555832, -0.20219683)
PLANCK_Y_MID = (-0.9549476, -1.37418593, 2.09137015, -0.16748867)
DAYLIGHT_Y = (-3.0, 2.87, -0.275)
SLOPE_LOW = (-3.3191442, -2.69622040, 2.18555832)
SLOPE_MID = (-2.8648428, -2.74837186, 2.09137015)
SLOPE_HIGH = (9.2452740, -11.7467734, 3.75112997)
MCCAMY = (449.0, 3525.0, 6823.3, 5520.33)
#: Temperatures and the red to green ratios of their illuminants.
KELVIN_TABLE = (
    (2000, 2.580), (2500, 1.948), (3000, 1.597), (3500, 1.382), (4000, 1.237), (4500, 1.133), (5000, 1.057), (5500, 0.999),
    (6000, 0.952), (6500, 0.914), (7000, 0.882), (7500, 0.856), (8000, 0.834), (9000, 0.799), (10000, 0.773), (12000, 0.737),
)


def rounded(value: Column, digits: int) -> Column:
    """Rounded by the product with a power of ten, halves away from zero, as DuckDB does; ``F.round`` rounds the decimal text of the float."""
    scale = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def _white_cones() -> list[float]:
    x, y = D65
    return [r[0] * x / y + r[1] + r[2] * (1 - x - y) / y for r in BRADFORD]


#: From the ratios of cone responses to linear sRGB of the white adapted by them: one matrix for three steps.
FROM_CONES = tuple(tuple(sum(row[k] * BRADFORD_INVERSE[k][j] for k in range(3)) * w for j, w in enumerate(_white_cones())) for row in XYZ_TO_SRGB)


def horner(x: Column, *coefficients: float) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def kelvin_x(kelvin: Column) -> Column:
    """CIE daylight locus from 4000 K on, Planckian locus below; clamped to 1667-25000 K."""
    t = F.least(F.greatest(kelvin.cast("double"), F.lit(1667.0)), F.lit(25000.0))
    u = 1.0 / t
    warm = horner(u, *PLANCK_X)
    day = horner(u, *DAYLIGHT_X)
    cool = horner(u, *COOL_X)
    return F.when(t < 4000, warm).when(t <= 7000, day).otherwise(cool)


def kelvin_y(kelvin: Column, x: Column | None = None) -> Column:
    t = F.least(F.greatest(kelvin.cast("double"), F.lit(1667.0)), F.lit(25000.0))
    x = kelvin_x(kelvin) if x is None else x
    low = horner(x, *PLANCK_Y_LOW)
    mid = horner(x, *PLANCK_Y_MID)
    return F.when(t <= 2222, low).when(t < 4000, mid).otherwise(horner(x, *DAYLIGHT_Y))


def _times(matrix: tuple, v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in matrix)


def _xyz(x: Column, y: Column) -> tuple[Column, Column, Column]:
    return x / y, F.lit(1.0), (1.0 - x - y) / y


def xy_kelvin(x: Column, y: Column) -> Column:
    """McCamy's temperature of a chromaticity, its ratio taken with the sign that the survey describes."""
    return horner((x - 0.3320) / (y - 0.1858), *MCCAMY)


def tint_duv(tint: Column) -> Column:
    return -tint / 3000.0


def locus_slope(kelvin: Column, x: Column) -> Column:
    """Slope of the Planckian locus at a temperature and its x."""
    inside = (kelvin >= 1667) & (kelvin <= 2222)
    return F.when(inside, horner(x, *SLOPE_LOW)).when((kelvin > 2222) & (kelvin <= 4000), horner(x, *SLOPE_MID)).otherwise(horner(x, *SLOPE_HIGH))


def tinted(kelvin: Column, tint: Column, x: Column, y: Column, slope: Column | None = None) -> tuple[Column, Column]:
    """A chromaticity moved off the Planckian locus, at a right angle to it, by the distance that stands for the tint; without tint it stays."""
    slope = locus_slope(kelvin, x) if slope is None else slope
    step = tint_duv(tint) / F.sqrt(1.0 + slope * slope)
    return F.when(tint == 0, x).otherwise(x + step * slope), F.when(tint == 0, y).otherwise(y - step)


def with_wb(df: DataFrame, target_k: Column, as_shot_k: Column, names: tuple[str, str, str] = ("r", "g", "b"), target_tint: Column | None = None, as_shot_tint: Column | None = None) -> DataFrame:
    """Adds (r, g, b) that make the as-shot white (temperature, tint) look like the target's, green at 1; 1 each if a temperature is not known (<= 0).

    The steps are columns of their own: as one expression they would not fit into one compiled method.
    """
    none = F.lit(0.0)
    kept = [c for c in df.columns if c not in names]
    step = df.select("*", ((target_k > 0) & (as_shot_k > 0)).alias("__known"), target_k.cast("double").alias("__tk"), as_shot_k.cast("double").alias("__sk"), (none if target_tint is None else target_tint).alias("__tt"), (none if as_shot_tint is None else as_shot_tint).alias("__st"))
    own = lambda p, *parts: [F.col(f"__{p}{part}") for part in parts]
    step = step.select("*", *[kelvin_x(*own(p, "k")).alias(f"__{p}x") for p in "ts"])
    step = step.select("*", *[c.alias(f"__{p}{n}") for p in "ts" for n, c in (("y", kelvin_y(*own(p, "k", "x"))), ("n", locus_slope(*own(p, "k", "x"))))])
    moved = {p: tinted(*own(p, "k", "t", "x", "y", "n")) for p in "ts"}
    step = step.select(*kept, "__known", *[c.alias(f"__{p}{n}") for p in "ts" for n, c in zip("uv", moved[p], strict=True)])
    cones = {p: _times(BRADFORD, _xyz(*own(p, "u", "v"))) for p in "ts"}
    step = step.select(*kept, "__known", *[F.when(s > 1e-4, t / s).otherwise(1.0).alias(f"__a{i}") for i, (t, s) in enumerate(zip(cones["t"], cones["s"], strict=True))])
    linear = _times(FROM_CONES, tuple(F.col(f"__a{i}") for i in range(3)))
    step = step.select(*kept, "__known", *[c.alias(f"__c{i}") for i, c in enumerate(linear)])
    green = F.when(F.col("__c1") > 1e-4, F.col("__c1")).otherwise(1.0)
    return step.select(*kept, *[F.when(F.col("__known"), F.col(f"__c{i}") / green).otherwise(1.0).alias(n) for i, n in enumerate(names)])


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear over ascending knots, constant beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        t = (x - xs[i]) / (xs[i + 1] - xs[i])
        out = F.when(x <= xs[i + 1], ys[i] + t * (ys[i + 1] - ys[i])).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def kelvin_from_ratio(red: Column, green: Column) -> Column:
    """Temperature whose illuminant has the inverse of the camera's red to green ratio; 5500 without green."""
    table = sorted((rg, k) for k, rg in KELVIN_TABLE)
    return F.when(green > 1e-4, interpolate(green / red, [r for r, _ in table], [float(k) for _, k in table])).otherwise(5500.0)


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601."""
    return 0.299 * r + 0.587 * g + 0.114 * b, -0.169 * r - 0.331 * g + 0.5 * b, 0.5 * r - 0.419 * g - 0.081 * b


def rgb_of(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.402 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.772 * cb


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - 2.0 * t)


def with_tone(df: DataFrame, rgb: tuple[str, str, str], settings: dict[str, Column], names: tuple[str, str, str] = ("out_r", "out_g", "out_b")) -> DataFrame:
    """Adds the developed colour of a pixel of gamma 2.2, 0 to 1.

    In linear light: exposure (stops), white balance (wb_r, wb_g, wb_b), contrast around 0.18, blacks, whites, then highlights and shadows by
    zones of luminance; back in gamma: saturation and vibrance, the latter weaker on saturated colours and on skin. Settings that are
    left out are neutral; all but exposure and white balance run from -100 to 100. Each step is a column of its own.
    """
    of = lambda name, neutral=0.0: settings.get(name, F.lit(neutral)) / (1.0 if name.startswith(("exposure", "wb")) else 100.0)
    luma = lambda: sum((F.col(f"__{c}") * w for c, w in zip("rgb", LUMA, strict=True)), F.lit(0.0))
    each = lambda step, change: step.withColumns({f"__{c}": change(F.col(f"__{c}")) for c in "rgb"})
    power = lambda v, p: F.pow(F.greatest(v, F.lit(0.0)), F.lit(p))
    step = df.withColumns({"__ev": F.pow(F.lit(2.0), of("exposure")), "__p": 1.0 + of("contrast") * 1.5, "__bl": of("blacks") * 0.06, "__wh": of("whites") * 0.06, "__hi": of("highlights") * 0.25, "__sh": of("shadows") * 0.30, "__sa": of("saturation"), "__vi": of("vibrance")})
    step = step.withColumns({f"__{c}": power(F.col(n), 2.2) * F.col("__ev") * of(f"wb_{c}", 1.0) for c, n in zip("rgb", rgb, strict=True)})
    step = each(step, lambda v: F.when(F.col("__p") != 1, 0.18 * F.pow(F.greatest(v, F.lit(0.00001)) / 0.18, F.col("__p"))).otherwise(v))
    b, w = F.col("__bl"), F.col("__wh")
    step = each(step, lambda v: F.when(b < 0, F.greatest((v + b) / (1.0 + b), F.lit(0.0))).otherwise(v * (1.0 - b) + b))
    step = each(step, lambda v: F.when(w > 0, v / (1.0 - w)).otherwise(v * (1.0 + w)))
    step = step.withColumn("__l", luma()).withColumn("__z", F.least(F.greatest(F.col("__l"), F.lit(0.0)), F.lit(1.0)))
    z = F.col("__z")
    step = step.withColumn("__adj", F.col("__hi") * smoothstep(0.55, 0.90, z) + F.col("__sh") * smoothstep(0.02, 0.08, z) * (1.0 - smoothstep(0.20, 0.40, z)))
    lum, adj = F.col("__l"), F.col("__adj")
    step = step.withColumns({"__ratio": F.greatest(lum + adj, F.lit(0.0)) / F.when(lum > 0.0001, lum).otherwise(1.0), "__mix": smoothstep(0.02, 0.10, lum)})

    def zoned(v: Column) -> Column:
        added = F.greatest(v + adj, F.lit(0.0))
        scaled = F.when(lum > 0.0001, v * F.col("__ratio")).otherwise(added)
        return F.when(adj != 0, added + (scaled - added) * F.col("__mix")).otherwise(v)

    step = each(each(step, zoned), lambda v: power(v, 1 / 2.2))
    step = step.withColumn("__g0", luma())  # one gray for both steps
    gray = F.col("__g0")
    step = each(step, lambda v: gray + (v - gray) * (1.0 + F.col("__sa")))
    colours = [F.col(f"__{c}") for c in "rgb"]
    step = step.withColumns({"__hi3": F.greatest(*colours), "__range": F.greatest(*colours) - F.least(*colours)})
    top, spread = F.col("__hi3"), F.col("__range")
    r, g, bl = colours
    turn = lambda v: v - 6.0 * F.floor(v / 6.0)  # noqa: E731  never negative
    wide = F.when(spread > 0.001, spread).otherwise(1.0)
    hue = F.when(top == r, turn((g - bl) / wide)).when(top == g, (bl - r) / wide + 2.0).otherwise((r - g) / wide + 4.0) / 6.0
    step = step.withColumn("__off", F.abs(hue - 0.055)).withColumn("__off", F.least("__off", 1.0 - F.col("__off")))
    skin = F.when(spread > 0.001, 1.0 - 0.6 * F.exp(-F.col("__off") * F.col("__off") / (2.0 * 0.042 * 0.042))).otherwise(1.0)
    pale = F.pow(1.0 - F.when(top > 0.001, spread / F.when(top > 0.001, top).otherwise(1.0)).otherwise(0.0), F.lit(1.5))
    step = step.withColumn("__v", 1.0 + F.col("__vi") * pale * skin)
    out = step.withColumns({n: F.when(F.col("__vi") != 0, gray + (F.col(f"__{c}") - gray) * F.col("__v")).otherwise(F.col(f"__{c}")) for n, c in zip(names, "rgb", strict=True)})
    return out.select(*[c for c in df.columns if c not in names], *names)


def chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luminance (a third of the sum), and the shares of red and green; black has none."""
    total = r + g + b + 1e-6
    return total / 3.0, r / total, g / total


def vignetting_gain(raw: Column) -> Column:
    return F.pow(F.lit(2.0), 0.5 - F.pow(F.lit(2.0), raw / 8192.0 - 1.0))


def distortion_factor(raw: Column) -> Column:
    return raw / 16384.0 + 1.0


def aberration_factor(raw: Column) -> Column:
    return raw / 2097152.0 + 1.0


def radial_warp(r: Column, k0: float, k1: float, k2: float, k3: float) -> Column:
    return horner(r * r, k3, k2, k1, k0)


def rotated_size(width: Column, height: Column, angle: Column) -> tuple[Column, Column]:
    """Bounding box of a rotated rectangle."""
    c, s = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    return width * c + height * s, width * s + height * c


def fit_long_edge(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size scaled down so that the long edge is at most ``most``; sides are rounded, at least 1. 0 sets no bound."""
    edge = F.greatest(width, height)
    scale = F.when((F.lit(most) > 0) & (edge > most), most / edge).otherwise(1.0)
    side = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("long")
    return side(width), side(height)


def polynomial_terms(names: list[str], degree: int) -> dict[str, Column]:
    """All products of up to ``degree`` columns, named by their letters: r, g, rr, rg, ..."""
    from itertools import combinations_with_replacement

    out = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(names, d):
            term = F.col(combo[0])
            for name in combo[1:]:
                term = term * F.col(name)
            out["".join(combo)] = term
    return out


def reoriented(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    """Origin of a normalised box after a quarter turn: orientation 6 and 8; others leave it."""
    return (
        F.when(orientation == 6, 1.0 - y - h).when(orientation == 8, y).otherwise(x),
        F.when(orientation == 6, x).when(orientation == 8, 1.0 - x - w).otherwise(y),
    )
