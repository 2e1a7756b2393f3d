"""Places by position and by name: the nearest place on the sphere, and the box that a name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.text import ascii_lower
from tessera.workspace import written

#: Squared chords on the unit sphere that agree to so many digits count as equal: metres.
DIGITS = 12


def _on_sphere(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    a, o = F.radians(F.col(lat)), F.radians(F.col(lon))
    return df.withColumns({f"{prefix}x": F.cos(a) * F.cos(o), f"{prefix}y": F.cos(a) * F.sin(o), f"{prefix}z": F.sin(a)})


def _cell(axis: str, side: float) -> Column:
    return F.floor(F.col(axis) / side).cast("int")


def nearest_place(points: DataFrame, places: DataFrame, place_id: str, lat: str = "lat", lon: str = "lon", start_km: float = 50.0) -> DataFrame:
    """Adds place_id, squared chord (``chord2``) and kilometres (``km``) of the nearest of ``places`` (place_id, lat, lon) to each point.

    Points and places on the unit sphere fall into cubes of a side; all places within a side of a point lie in the 27 cubes around its own, which an
    equi join brings. A point whose best place is nearer than the side is done, as no unseen place can be; for the others the side doubles, at the
    end to the whole sphere. So poles and the date line need no care. Equal distances (to ``DIGITS`` digits of the squared chord) go to the smaller id. Each distinct position is
    looked up once, and a place of a position that others share stands for them by its id. Points without a position (null) and any point
    where there are no places get nulls; places without a position or id are passed over.
    """
    spots = points.select(F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon")).where("plat is not null and plon is not null").distinct()
    left = written(_on_sphere(spots, "plat", "plon", "p"), "spots")
    known = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(place_id).isNotNull())
    known = known.groupBy(F.col(lat).cast("double").alias("qlat"), F.col(lon).cast("double").alias("qlon")).agg(F.min(place_id).alias("place"))
    known = written(_on_sphere(known, "qlat", "qlon", "q"), "places")
    found, side = None, start_km / geo.EARTH_KM
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    while not left.isEmpty() and not known.isEmpty():
        cells = [_cell(f"q{a}", side).alias(f"c{a}") for a in "xyz"]
        seen = left.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j")).select("*", F.explode(steps).alias("k"))
        near = seen.select(*left.columns, *[(_cell(f"p{a}", side) + F.col(n)).alias(f"c{a}") for a, n in zip("xyz", "ijk", strict=True)])
        met = near.join(known.select("place", "qx", "qy", "qz", *cells), ["cx", "cy", "cz"])
        chord2 = F.round(sum(((F.col(f"p{a}") - F.col(f"q{a}")) ** 2 for a in "xyz"), F.lit(0.0)), DIGITS)
        best = met.select("plat", "plon", chord2.alias("chord2"), "place").groupBy("plat", "plon").agg(F.min(F.struct("chord2", "place")).alias("b"))
        done = written(best.where((F.col("b.chord2") < side * side - 10.0 ** (1 - DIGITS)) | F.lit(side > 2.0)).select("plat", "plon", "b.*"), "nearest")
        found = done if found is None else found.unionByName(done)
        left = written(left.join(done, ["plat", "plon"], "left_anti"), "spots")
        side *= 2
    if found is None:
        kind = dict(places.dtypes)[place_id]
        return points.withColumns({place_id: F.lit(None).cast(kind), "chord2": F.lit(None).cast("double"), "km": F.lit(None).cast("double")})
    named = found.select(F.col("plat").alias("__lat"), F.col("plon").alias("__lon"), F.col("place").alias(place_id), "chord2", (2 * geo.EARTH_KM * F.asin(F.sqrt("chord2") / 2)).alias("km"))
    return points.join(named, (F.col(lat).cast("double") == F.col("__lat")) & (F.col(lon).cast("double") == F.col("__lon")), "left").drop("__lat", "__lon")


def named_box(searches: DataFrame, places: DataFrame, name: str = "name", rank: str = "rank", span: float = 0.05) -> DataFrame:
    """Adds south, north, west, east of the place that each search (name) means: the one of that name, in any ASCII case and without outer blanks, with the least ``rank``.

    A place without a box has its point and ``span`` degrees around it; a side shorter than ``span`` becomes ``span`` each way from its middle. Unknown names give nulls.
    """
    key = lambda c: ascii_lower(F.trim(F.col(c)))
    point = lambda side, axis, way: F.coalesce(F.col(side), F.col(axis) + way * span).alias(side)
    boxed = places.select(key(name).alias("__name"), rank, point("south", "lat", -1), point("north", "lat", 1), point("west", "lon", -1), point("east", "lon", 1))
    best = boxed.groupBy("__name").agg(F.min(F.struct(rank, "south", "north", "west", "east")).alias("b")).select("__name", "b.south", "b.north", "b.west", "b.east")
    for low, high in (("south", "north"), ("west", "east")):
        middle, small = (F.col(low) + F.col(high)) / 2, F.col(high) - F.col(low) < span
        best = best.withColumns({low: F.when(small, middle - span).otherwise(F.col(low)), high: F.when(small, middle + span).otherwise(F.col(high))})
    return searches.withColumn("__name", key(name)).join(best, "__name", "left").drop("__name")
