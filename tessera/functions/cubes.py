"""Colours sent through lookup cubes: interpolation along all three axes between the nodes of a cell."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = list(product((0, 1), repeat=3))  # offsets along r, g, b
SUMMED = sorted(range(len(CORNERS)), key=lambda i: (CORNERS[i][0], CORNERS[i][2], CORNERS[i][1]))  # the order in which corners are added up: sums of floats turn on it


def cube_cells(nodes: DataFrame, keys: list[str], size: str = "size", gains: tuple[str, str, str] | None = None) -> DataFrame:
    """(keys, size, cr, cg, cb, corners) of every cell of the cubes ``nodes`` (keys, size, ri, gi, bi, r, g, b): its eight nodes, r, g, b each, in the order of ``CORNERS``.

    ``gains`` names a factor on each of r, g, b, kept apart (r, g, b, gains) so that ``with_cube`` multiplies in that order. A node is part of up to eight cells and is sent to each; cubes of one node along an axis have no cells.
    """
    at = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in CORNERS])).alias("c")
    sent = nodes.select(*keys, size, "ri", "gi", "bi", F.array("r", "g", "b", *(gains or ())).alias("v"), at)
    place = {f"c{axis}": F.col(f"{axis}i") - F.col("c")[k] for k, axis in enumerate("rgb")}
    inside = [(F.col(c) >= 0) & (F.col(c) < F.col(size) - 1) for c in place]
    cells = sent.withColumns(place).where(inside[0] & inside[1] & inside[2]).groupBy(*keys, size, *place)
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("corners")).where(F.size("corners") == len(CORNERS))


def _clamped(channel: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(channel)))


def with_cube(pixels: DataFrame, cells: DataFrame, keys: list[str], channels: tuple[str, str, str] = ("r", "g", "b"), blend: str | None = None, gained: bool = False) -> DataFrame:
    """Adds out_r, out_g, out_b: the colours of ``pixels`` (keys, channels) sent through the cube of their keys, mixed with themselves by ``blend`` (1 where there is none); ``gained`` tells that ``cells`` hold gains.

    Colours are cut to 0 to 1 for the lookup, so edges stay; a pixel without a cube, or with a null channel, keeps its colour. Pixels meet their cell alone
    by an equi join, so a pixel never carries a cube, and few or many cubes are left to the optimizer. ``pixels`` has a column ``size``
    neither before nor after.
    """
    sizes = cells.groupBy(*keys).agg(F.max("size").alias("__size"))
    told = pixels.join(sizes, keys, "left")
    spot = {f"__p{c}": _clamped(c) * (F.col("__size") - 1) for c in channels}
    told = told.withColumns(spot)
    told = told.withColumns({f"__c{k}": F.least(F.floor(f"__p{c}"), F.col("__size") - 2).cast("int") for k, c in enumerate(channels)})
    named = cells.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(f"c{a}").alias(f"__cell{i}") for i, a in enumerate("rgb")], "corners")
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(f"__c{i}") == F.col(f"__cell{i}") for i in range(3)]
    met = told.join(named, reduce(lambda a, b: a & b, same), "left")
    spots = [(F.col(f"__p{c}"), F.col(f"__c{k}")) for k, c in enumerate(channels)]
    weights = [reduce(lambda a, b: a * b, [at - low if up else 1 - at + low for (at, low), up in zip(spots, corner, strict=True)]) for corner in CORNERS]
    share = F.col(blend) if blend else F.lit(1.0)
    out = {}
    for k, c in enumerate(channels):
        value = lambda i: weights[i] * F.col("corners")[i][k] * F.col("corners")[i][k + 3] if gained else weights[i] * F.col("corners")[i][k]  # noqa: B023, E731
        looked = reduce(add, map(value, SUMMED))
        out[f"out_{c}"] = F.coalesce(F.col(c) + (looked - F.col(c)) * share, F.col(c))
    return met.select(*pixels.columns, *[v.alias(n) for n, v in out.items()])
