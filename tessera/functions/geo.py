"""Geographic and box functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_score(km: Column) -> Column:
    return 1.0 / (1.0 + km / 2.0)


def has_gps(lat: Column, lon: Column) -> Column:
    """A point at exactly (0, 0) is none."""
    return (lat != 0) | (lon != 0)


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Bounds included; no wrap at the antimeridian."""
    return has_gps(lat, lon) & lat.between(south, north) & lon.between(west, east)


def mercator_x(lon: Column, zoom: Column) -> Column:
    return (lon + 180.0) / 360.0 * 256.0 * F.pow(F.lit(2.0), zoom)


def mercator_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * 256.0 * F.pow(F.lit(2.0), zoom)


def mercator_lon(x: Column, zoom: Column) -> Column:
    return x / (256.0 * F.pow(F.lit(2.0), zoom)) * 360.0 - 180.0


def mercator_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / (256.0 * F.pow(F.lit(2.0), zoom))))))


def intersection(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    side = lambda a, an, b, bn: F.greatest(F.lit(0.0), F.least(a + an, b + bn) - F.greatest(a, b))
    return side(ax, aw, bx, bw) * side(ay, ah, by, bh)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union; 0 for boxes without area."""
    both = intersection(ax, ay, aw, ah, bx, by, bw, bh)
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over the smaller box; 0 for boxes without area."""
    least = F.least(aw * ah, bw * bh)
    return F.when(least > 0, intersection(ax, ay, aw, ah, bx, by, bw, bh) / least).otherwise(0.0)


def least_span(low: Column, high: Column, span: float) -> tuple[Column, Column]:
    """An interval shorter than ``span`` becomes its middle plus and minus ``span``."""
    short, middle = high - low < span, (low + high) / 2
    return F.when(short, middle - span).otherwise(low), F.when(short, middle + span).otherwise(high)
