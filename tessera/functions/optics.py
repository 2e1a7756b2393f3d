"""Geometry of lenses, crops and faces: warps, crop quads, correction tables, similarity transforms, detector boxes."""

from __future__ import annotations

from collections.abc import Callable

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.workspace import spread

#: Places of eyes, nose and corners of the mouth in an aligned face of 112 by 112.
FACE_TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
FOCAL = 28.0  # millimetres at full frame, where a photo has none
LEAST_DEPTH = 0.001
LUMA = (0.2126, 0.7152, 0.0722)
TABLE_ROWS = 1 << 16


def _focal(mm: Column) -> tuple[Column, Column]:
    known = F.when(mm > 0, mm.cast("double")).otherwise(FOCAL)
    return known / 36.0, known / 24.0


def _tilted(x: Column, z: Column, angle: Column, ahead: bool) -> tuple[Column, Column]:
    """A turn in one plane, or back: the coordinate beside the axis and the depth."""
    c, s = F.cos(angle), F.sin(angle)
    return (c * x - s * z, s * x + c * z) if ahead else (c * x + s * z, c * z - s * x)


def forward_warp(u: Column, v: Column, shear: Column, tilt_v: Column, tilt_h: Column, focal: Column) -> tuple[Column, Column]:
    """Where a source point (0 to 1) lands after shear and perspective; tilts in degrees."""
    fx, fy = _focal(focal)
    sheared = u + shear * (v - 0.5)
    one = F.lit(1.0)
    x, depth = _tilted((sheared - 0.5) / fx, one, F.radians(tilt_h), ahead=False)
    y, depth = _tilted((v - 0.5) / fy, depth, F.radians(tilt_v), ahead=True)
    depth = F.greatest(depth, F.lit(LEAST_DEPTH))
    flat = (tilt_v == 0) & (tilt_h == 0)
    return F.when(flat, sheared).otherwise(fx * x / depth + 0.5), F.when(flat, v).otherwise(fy * y / depth + 0.5)


def inverse_warp(u: Column, v: Column, shear: Column, tilt_v: Column, tilt_h: Column, focal: Column) -> tuple[Column, Column]:
    """The source point that ``forward_warp`` sends to (u, v)."""
    fx, fy = _focal(focal)
    one = F.lit(1.0)
    y, depth = _tilted((v - 0.5) / fy, one, F.radians(tilt_v), ahead=False)
    x, depth = _tilted((u - 0.5) / fx, depth, F.radians(tilt_h), ahead=True)
    depth = F.greatest(depth, F.lit(LEAST_DEPTH))
    back_v = fy * y / depth + 0.5
    flat = (tilt_v == 0) & (tilt_h == 0) & (shear == 0)
    return F.when(flat, u).otherwise(fx * x / depth + 0.5 - shear * (back_v - 0.5)), F.when(flat, v).otherwise(back_v)


def _turned(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


PROBES = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5))


def with_warped_size(df: DataFrame, width: str, height: str, angle: str, shear: str, tilt_v: str, tilt_h: str, focal: str) -> DataFrame:
    """Adds box_w and box_h: the bounding box of the warped and turned image, by its corners and the middles of its edges."""
    turned = []
    for u, v in PROBES:
        wu, wv = forward_warp(F.lit(u), F.lit(v), F.col(shear), F.col(tilt_v), F.col(tilt_h), F.col(focal))
        x, y = _turned((wu - 0.5) * F.col(width), (wv - 0.5) * F.col(height), F.col(angle))
        turned.append(F.struct(x.alias("x"), y.alias("y")))
    step = df.withColumn("__at", F.array(*turned))
    spread = lambda f: F.array_max(F.transform("__at", lambda p: p[f])) - F.array_min(F.transform("__at", lambda p: p[f]))
    return step.withColumns({"box_w": spread("x"), "box_h": spread("y")}).drop("__at")


def crop_point(bx: Column, by: Column, width: str, height: str, angle: str, shear: str, tilt_v: str, tilt_h: str, focal: str) -> tuple[Column, Column]:
    """The source point (0 to 1) of a point of the bounding box (0 to 1), of rows that have box_w and box_h."""
    x, y = _turned((bx - 0.5) * F.col("box_w"), (by - 0.5) * F.col("box_h"), -F.col(angle))
    return inverse_warp(x / F.col(width) + 0.5, y / F.col(height) + 0.5, F.col(shear), F.col(tilt_v), F.col(tilt_h), F.col(focal))


def crop_quad(crop: tuple[str, str, str, str], **names: str) -> Column:
    """The four corners of a crop (x, y, w, h of the box) in the source, from the top left clockwise: array of (u, v)."""
    x, y, w, h = map(F.col, crop)
    corners = [crop_point(px, py, **names) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in corners))


def crop_output(crop_w: Column, crop_h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    side = lambda part, whole: F.greatest(F.lit(1), F.floor(part * whole + 0.5)).cast("long")
    return side(crop_w, box_w), side(crop_h, box_h)


def crop_scale(src_w: Column, src_h: Column, whole_w: Column, whole_h: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Scale from the sensor's size to the source's. A size that is not known (0) is taken to have equal margins on both sides, where the crop would not fit."""
    told = (whole_w > 0) & (whole_h > 0) & (src_w != whole_w)
    guessed = (whole_w == 0) & ((x + w > src_w) | (y + h > src_h))
    return (
        F.when(told, src_w / whole_w).when(guessed, src_w / (x + w + x)).otherwise(1.0),
        F.when(told, src_h / whole_h).when(guessed, src_h / (y + h + y)).otherwise(1.0),
    )


def crop_centre(src: Column, at: Column, size: Column, scale: Column) -> tuple[Column, Column]:
    """Along one side: the output's size and the crop's centre in source pixels."""
    out = F.greatest(F.lit(1), F.floor(size * scale + 0.5)).cast("long")
    return out, at * scale + (out - 1) * 0.5


def _interpolated(x: np.ndarray, knots: list | None, values: list | None) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether null), piecewise linear over ascending knots and their values, constant beyond the ends; null without knots or values."""
    last = 0 if knots is None or values is None else min(len(knots), len(values))
    if not last:
        return np.zeros(len(x)), np.ones(len(x), dtype=bool)
    k, v = (np.array(c[:last], dtype=float) for c in (knots, values))
    at = np.where(np.isnan(x), last, (k[:, None] < x).sum(0))  # knots below x
    high = np.clip(at, 1, max(1, last - 1)) if last > 1 else np.zeros(len(x), dtype=int)
    low = np.maximum(high - 1, 0)
    with np.errstate(all="ignore"):
        inside = v[low] + (x - k[low]) / (k[high] - k[low]) * (v[high] - v[low])
    found = np.where(at <= 0, v[0], np.where(at >= last, v[-1], inside))
    if None not in knots[:last] and None not in values[:last]:
        return found, np.zeros(len(x), dtype=bool)
    gone, lost = (np.array([e is None for e in c[:last]]) for c in (values, knots))
    return found, np.where(at <= 0, gone[0], np.where(at >= last, gone[-1], gone[low] | gone[high] | lost[low] | lost[high]))


def _tables(lenses: DataFrame, key: str, columns: list[str], places: dict[str, np.ndarray], values: str, table: Callable) -> DataFrame:
    """(key, places, values) for each lens: ``table`` gives from its ``columns`` an array and its nulls for each of ``values``, one entry for each of the places.

    Lenses are dealt to all tasks, each table is one numpy call, and rows leave in batches of some ``TABLE_ROWS``.
    """
    size = len(next(iter(places.values())))
    step = max(1, TABLE_ROWS // size)
    rows = spread(lenses.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)]))
    names = ["key", *places, *values.split()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                tables = [table(*row) for row in zip(*[part.column(i + 1).to_pylist() for i in range(len(columns))], strict=True)]
                found = [pa.array(np.concatenate([t[j][0] for t in tables]), mask=np.concatenate([t[j][1] for t in tables])) for j in range(len(names) - 1 - len(places))]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), size)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.tile(p.astype(np.int32), part.num_rows)) for p in places.values()], *found], names=names)

    kind = StructType([StructField("key", lenses.schema[key].dataType), *[StructField(n, IntegerType()) for n in places], *[StructField(n, DoubleType()) for n in values.split()]])
    return rows.mapInArrow(made, kind).withColumnRenamed("key", key)


def distortion_table(lenses: DataFrame, key: str, knots: str, distortion: str, red: str, blue: str, size: int = 512) -> DataFrame:
    """(key, i, r, g, b): ``size`` factors of each colour along the radius; a null red or blue has none of its own."""
    i = np.arange(size)
    radius = i / float(size - 1)

    def table(k, d, r, b):
        base, none = _interpolated(radius, k, d)
        own = []
        for c in (r, b):
            factor, gone = _interpolated(radius, k, c) if r is not None and b is not None else (1.0, False)
            own.append((base * factor, none | gone))
        return own[0], (base, none), own[1]

    return _tables(lenses, key, [knots, distortion, red, blue], {"i": i}, "r g b", table)


def vignetting_map(lenses: DataFrame, key: str, width: str, height: str, knots: str, vignetting: str, size: int = 64) -> DataFrame:
    """(key, y, x, gain): one over the correction at each cell's middle, the correction at least 0.01."""
    y, x = (c.ravel() for c in np.mgrid[0:size, 0:size])

    def table(w, h, k, v):
        if w is None or h is None:
            return ((np.zeros(size * size), np.ones(size * size, dtype=bool)),)
        cx, cy = (w - 1) * 0.5, (h - 1) * 0.5
        px, py = (x + 0.5) / size * (w - 1) - cx, (y + 0.5) / size * (h - 1) - cy
        with np.errstate(all="ignore"):
            return (_interpolated(np.sqrt(px * px + py * py) / np.sqrt(cx * cx + cy * cy), k, v),)

    cells = _tables(lenses, key, [width, height, knots, vignetting], {"y": y, "x": x}, "gain", table)
    return cells.withColumn("gain", 1.0 / F.greatest("gain", F.lit(0.01)))


def auto_scale(df: DataFrame, out: str = "scale", steps: int = 20, most: float = 1.5) -> DataFrame:
    """Adds the least scale (1 to ``most``) at which no corner or middle of an edge of the output is taken from outside the crop.

    Rows have src_w, src_h, out_w, out_h, crop_cx, crop_cy, knots, distortion, red, blue (null: none). A bisection of ``steps`` steps,
    all rows of an Arrow batch at once.
    """

    @F.pandas_udf("double")
    def least(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for sizes in batches:
            *plain, knots, distortion, red, blue = sizes
            coloured = red.notna() & blue.notna()
            count = knots.map(len)
            found = pd.Series(np.nan, index=knots.index)
            for (_, own_colours), own in count.groupby([count, coloured]).groups.items():  # rows of equally many knots are one array
                lines = [np.stack(c.loc[own].to_list()).astype(float) for c in (knots, distortion, *((red, blue) if own_colours else ()))]
                found.loc[own] = _least_scales(*(c.loc[own].to_numpy(dtype=float) for c in plain), *lines, steps=steps, most=most)
            yield found

    names = ("src_w", "src_h", "out_w", "out_h", "crop_cx", "crop_cy", "knots", "distortion", "red", "blue")
    return df.withColumn(out, least(*names))


def _on_lines(x: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Piecewise linear, each row of ``x`` over its own row of ascending knots, constant beyond the ends."""
    if knots.shape[1] == 1:
        return np.broadcast_to(values, x.shape)
    at = np.clip((knots[:, None, :] < x[:, :, None]).sum(axis=2), 1, knots.shape[1] - 1)
    low, high = (np.take_along_axis(knots, at - d, axis=1) for d in (1, 0))
    before, after = (np.take_along_axis(values, at - d, axis=1) for d in (1, 0))
    return before + np.clip((x - low) / (high - low), 0.0, 1.0) * (after - before)


def _least_scales(src_w, src_h, out_w, out_h, cx, cy, knots, distortion, *colours, steps: int, most: float) -> np.ndarray:
    half = np.stack([(out_w - 1) * 0.5, (out_h - 1) * 0.5], axis=1)
    probes = (np.array(PROBES) - 0.5)[None] * 2 * half[:, None]  # row, probe, axis
    centre, middle = np.stack([cx, cy], axis=1)[:, None], np.stack([(src_w - 1) * 0.5, (src_h - 1) * 0.5], axis=1)[:, None]
    reach = np.hypot(middle[..., 0], middle[..., 1])

    def fits(scale: np.ndarray) -> np.ndarray:
        away = centre + probes / scale[:, None, None] - middle
        radius = np.sqrt((away**2).sum(axis=2)) / reach
        main = _on_lines(radius, knots, distortion)
        factors = [main, *(main * _on_lines(radius, knots, c) for c in colours)]
        return np.all([(np.abs(away * f[:, :, None] + middle - centre) <= half[:, None] + 1e-9).all(axis=(1, 2)) for f in factors], axis=0)

    low, high = np.ones(len(half)), np.full(len(half), float(most))
    as_is = fits(low)
    for _ in range(steps):
        mid = (low + high) / 2
        good = fits(mid)
        low, high = np.where(good, low, mid), np.where(good, mid, high)
    return np.where(as_is, 1.0, high)


def similarity(sx: Column, sy: Column, template: tuple = FACE_TEMPLATE) -> Column:
    """The turn, scale and shift that bring points (arrays of x and y) nearest to the template: struct (a, b, tx, ty) of x' = a x - b y + tx, y' = b x + a y + ty."""
    n = float(len(template))
    dx, dy = F.array(*(F.lit(p[0]) for p in template)), F.array(*(F.lit(p[1]) for p in template))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    mx, my = total(sx) / n, total(sy) / n
    ux, uy = sum(p[0] for p in template) / n, sum(p[1] for p in template) / n
    cross = lambda s, m, d, u: dot(s, d) - n * m * u
    theta = F.atan2(cross(sy, my, dx, ux) - cross(sx, mx, dy, uy), cross(sx, mx, dx, ux) + cross(sy, my, dy, uy))
    c, s = F.cos(theta), F.sin(theta)
    spread = dot(sx, sx) - n * mx * mx + dot(sy, sy) - n * my * my
    along = c * (cross(sx, mx, dx, ux) + cross(sy, my, dy, uy)) + s * (cross(sx, mx, dy, uy) - cross(sy, my, dx, ux))
    scale = F.when(spread > 1e-6, along / spread).otherwise(1.0)
    a, b = scale * c, scale * s
    return F.struct(a.alias("a"), b.alias("b"), (ux - a * mx + b * my).alias("tx"), (uy - b * mx - a * my).alias("ty"))


def decoded_box(cx: Column, cy: Column, stride: Column, sides: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of a detector's box from its anchor and the four distances (left, top, right, bottom) in strides."""
    d = [F.get(sides, F.lit(i)) * stride for i in range(4)]
    return cx - d[0], cy - d[1], d[0] + d[2], d[1] + d[3]


def decoded_points(cx: Column, cy: Column, stride: Column, offsets: Column) -> Column:
    """Landmarks (x, y) of a detector from its anchor and pairs of offsets in strides."""
    pairs = F.sequence(F.lit(0), (F.size(offsets) / 2).cast("int") - 1)
    return F.transform(pairs, lambda k: F.struct((cx + F.get(offsets, 2 * k) * stride).alias("x"), (cy + F.get(offsets, 2 * k + 1) * stride).alias("y")))


GOLDEN = 2 * math.pi * (1 - 1 / 1.618033988749895)
FIRST = -2 * math.pi * 0.19


def golden_place(share: Column, rank: Column, inner: float = 270.0, ring: float = 200.0) -> tuple[Column, Column]:
    """x and y on a ring: better shares (0 to 1) nearer, each rank (from 0) a golden angle on."""
    away = inner + (1.0 - share * share) * ring
    angle = FIRST + rank * GOLDEN
    return F.cos(angle) * away, F.sin(angle) * away


def inverse_of(forward: Callable[[Column], Column], target: Column, high: float, steps: int = 50) -> Column:
    """Where in 0 to ``high`` a growing function has the value ``target``, by halving; the nearer end where it lies outside, null for a null target."""
    halve = lambda span, _: F.transform(  # noqa: E731  an array of one holds the middle, so that it is made once
        F.array((span["lo"] + span["hi"]) / 2), lambda mid: F.when(forward(mid) < target, F.struct(mid.alias("lo"), span["hi"].alias("hi"))).otherwise(F.struct(span["lo"].alias("lo"), mid.alias("hi")))
    )[0]
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(high)).alias("hi"))
    return F.when(target.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda span: (span["lo"] + span["hi"]) / 2))


def gain_at(gain: Column, x: Column, y: Column, width: Column, height: Column, channel: int) -> Column:
    """The gain of a map (rows, cols, planes, data) that spans the whole image, at a pixel, between its four nearest points; a map of fewer than three planes has one for all channels.

    Maps of one row or column are even along it; null where there is no map.
    """
    rows, cols, planes = gain["rows"], gain["cols"], gain["planes"]
    plane = F.when(planes >= 3, channel).otherwise(0)

    def spot(at: Column, size: Column, points: Column) -> tuple[Column, Column, Column]:
        place = at / F.greatest(size - 1, F.lit(1)) * (points - 1)
        first = F.greatest(F.lit(0), F.least(F.floor(place), points - 2)).cast("int")
        return first, F.least(first + 1, points - 1), place - first

    (x0, x1, fx), (y0, y1, fy) = spot(x, width, cols), spot(y, height, rows)
    value = lambda row, col: F.get(gain["data"], (row * cols + col) * planes + plane).cast("double")
    return value(y0, x0) * (1 - fx) * (1 - fy) + value(y0, x1) * fx * (1 - fy) + value(y1, x0) * (1 - fx) * fy + value(y1, x1) * fx * fy


def to_linear(v: Column) -> Column:
    """sRGB, 0 to 1, to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
