"""Means and variances of pixels in a square box, by summed-area tables of tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


def _window_sums(table: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the boxes around all inner places of a table with a border of ``radius``."""
    sums = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    sums[1:, 1:] = table.cumsum(0).cumsum(1)
    side = 2 * radius + 1
    return sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]


def box_stats(pixels: DataFrame, image: str = "image", x: str = "x", y: str = "y", value: str = "value", radius: int = 3, tile: int = TILE) -> DataFrame:
    """(image, x, y, value, n, mean, variance): of each pixel, how many samples its box of 2 ``radius`` + 1 by as many holds, their mean and their variance.

    Pixels are dealt to square tiles, those near an edge also to the tiles beside, so that each tile is worked on alone: an image of any size is never in
    one task, and one shuffle of little more than the pixels is all. Boxes are cut at the image's borders, and where pixels are missing. A null or NaN value
    is no sample, but has a box; the box is null where it holds none. Samples that repeat a place all count, and each gives a row; a null image is an image, a
    null place gives nothing. x and y are whole numbers of any sign.
    """
    if not 0 < radius < tile:
        raise ValueError(f"radius must be between 1 and {tile - 1}")
    kind = dict(pixels.dtypes)[image]
    rows = pixels.select(F.col(image).alias("image"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(value).cast("double").alias("value")).where("x is not null and y is not null")
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("long") for d in (-radius, 0, radius)])))
    dealt = rows.select("*", near("x").alias("tx")).select("*", near("y").alias("ty"))

    def stats(group: pa.Table) -> pa.Table:
        left, top = (group.column(c)[0].as_py() * tile - radius for c in ("tx", "ty"))
        at_x, at_y = (group.column(c).to_numpy() - edge for c, edge in (("x", left), ("y", top)))
        values = group.column("value").to_numpy(zero_copy_only=False).astype(float)
        known = np.isfinite(values)
        shape = (tile + 2 * radius, tile + 2 * radius)
        middle = values[known].mean() if known.any() else 0.0  # keeps squares small
        tables = []
        for part in (np.ones(known.sum()), values[known] - middle, (values[known] - middle) ** 2):
            table = np.zeros(shape)
            np.add.at(table, (at_y[known], at_x[known]), part)
            tables.append(_window_sums(table, radius))
        own = np.flatnonzero((at_x >= radius) & (at_x < tile + radius) & (at_y >= radius) & (at_y < tile + radius))
        n, s, q = (t[at_y[own] - radius, at_x[own] - radius] for t in tables)
        n = np.rint(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            variance = np.maximum(q / n - mean * mean, 0.0)
        found = group.select(["image", "x", "y", "value"]).take(pa.array(own))
        none = n == 0
        for name, column in (("n", pa.array(n.astype(np.int64))), ("mean", pa.array(mean + middle, mask=none)), ("variance", pa.array(variance, mask=none))):
            found = found.append_column(name, column)
        return found

    return dealt.groupBy("image", "tx", "ty").applyInArrow(stats, f"image {kind}, x long, y long, value double, n long, mean double, variance double")


def smoothed(value: Column, mean: Column, variance: Column, noise: float) -> Column:
    """A pixel drawn to its box's mean where the variance is no more than noise, kept where it is far more."""
    weight = F.greatest(F.lit(0.0), (variance - noise) / F.greatest(variance, F.lit(1e-10)))
    return mean + weight * (value - mean)
