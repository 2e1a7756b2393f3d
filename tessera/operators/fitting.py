"""Least squares by distributed normal equations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_equations(rows: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y in one aggregate; only these small matrices reach the driver."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate([*xs, y])]
    got = rows.agg(*sums).first()
    full = np.array([[got[f"{i}_{j}"] or 0.0 for j in range(len(xs) + 1)] for i in range(len(xs))], dtype=float)
    return full[:, :-1], full[:, -1]


def fitted(xs: list[str], weights: np.ndarray):
    out = F.lit(0.0)
    for x, w in zip(xs, weights, strict=True):
        out = out + F.col(x) * float(w)
    return out


def sigma_clipped(rows: DataFrame, y: str, xs: list[str], sigmas: float = 2.5, rounds: int = 3, survivors: float = 0.5) -> DataFrame:
    """(term, weight, share): a fit repeated without the rows whose residual is over ``sigmas`` deviations, in up to ``rounds`` rounds.

    share is the part of the rows that the last fit used; a round that would leave less than ``survivors`` of them ends the loop.
    """
    total = rows.count()
    used, kept, weights = rows, total, np.zeros(len(xs))
    for _ in range(rounds):
        a, b = normal_equations(used, y, xs)
        weights = np.linalg.lstsq(a, b, rcond=None)[0]
        off = F.col(y) - fitted(xs, weights)
        spread = used.agg(F.stddev_pop(off).alias("s")).first()["s"] or 0.0
        tighter = rows.where(F.abs(off) <= sigmas * spread)
        left = tighter.count()
        if left == kept or left < survivors * total:
            break
        used, kept = tighter, left
    share = kept / total if total else 0.0
    return rows.sparkSession.createDataFrame([(x, float(round(w, 6)), share) for x, w in zip(xs, weights, strict=True)], "term string, weight double, share double")


def rgb_terms(order: int = 3) -> list[tuple[str, ...]]:
    """Products of r, g and b up to an order, without a constant: 9 terms of order 2, 19 of order 3."""
    return [c for n in range(1, order + 1) for c in combinations_with_replacement("rgb", n)]


def _term(names: tuple[str, ...], of: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a * b, (of[n] for n in names))


def fit_lut(pixels: DataFrame, order: int = 3, dark: float = 0.03) -> np.ndarray:
    """Weights (terms by channels) of a polynomial from (r, g, b) to (tr, tg, tb), by least squares over all pixels whose sum is over ``dark``."""
    of = {n: F.col(n) for n in "rgb"}
    terms = rgb_terms(order)
    rows = pixels.where(F.col("r") + F.col("g") + F.col("b") > dark).select(*[_term(t, of).alias("".join(t)) for t in terms], "tr", "tg", "tb")
    return solve_channels(rows, ["".join(t) for t in terms])


def solve_channels(rows: DataFrame, xs: list[str], ys: tuple[str, ...] = ("tr", "tg", "tb")) -> np.ndarray:
    """Least squares of several columns on the same terms, in one aggregate; a second one for what the first leaves takes off its rounding."""

    def sums(pairs: list[tuple[Column, Column]]) -> list[float]:
        got = rows.agg(*[F.sum(a * b).alias(str(k)) for k, (a, b) in enumerate(pairs)]).first()
        return [float(v or 0.0) for v in got]

    n = len(xs)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    square = np.zeros((n, n))
    square[tuple(zip(*upper, strict=True))] = sums([(F.col(xs[i]), F.col(xs[j])) for i, j in upper])
    square = square + np.triu(square, 1).T
    weights = np.zeros((n, len(ys)))
    for _ in range(2):
        rest = [F.col(y) - fitted(xs, weights[:, k]) for k, y in enumerate(ys)]
        right = np.array(sums([(F.col(x), r) for x in xs for r in rest])).reshape(n, len(ys))
        weights = weights + np.linalg.lstsq(square, right, rcond=1e-14)[0]
    return weights


def predicted(weights: np.ndarray, of: dict[str, Column], order: int) -> list[Column]:
    """The polynomial's value for each channel."""
    terms = [_term(t, of) for t in rgb_terms(order)]
    return [reduce(lambda a, b: a + b, (t * float(w) for t, w in zip(terms, weights[:, k], strict=True))) for k in range(weights.shape[1])]


def lut_grid(spark: SparkSession, size: int = 33) -> DataFrame:
    """(ri, gi, bi, r, g, b): the nodes of a colour cube."""
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    cube = spark.range(1).select(F.explode(axis).alias("ri")).select("ri", F.explode(axis).alias("gi")).select("ri", "gi", F.explode(axis).alias("bi"))
    return cube.withColumns({c: F.col(f"{c}i") / float(size - 1) for c in "rgb"})


def polynomial_lut(pixels: DataFrame, size: int = 33, order: int = 3) -> DataFrame:
    """(ri, gi, bi, vr, vg, vb): the polynomial's values at the nodes of a cube, cut to 0 to 1."""
    grid = lut_grid(pixels.sparkSession, size)
    values = predicted(fit_lut(pixels, order), {c: F.col(c) for c in "rgb"}, order)
    return grid.select("ri", "gi", "bi", *[F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(f"v{c}") for c, v in zip("rgb", values, strict=True)])


#: Luminance weights, and colours that the ratio fit holds to themselves.
LUMA = (0.2126, 0.7152, 0.0722)
ANCHORS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0.5, 0.5, 0.5))


def ratio_lut(patches: DataFrame, size: int = 33) -> DataFrame:
    """(ri, gi, bi, vr, vg, vb): a cube that changes hue and saturation as the patches (r, g, b) to (tr, tg, tb) do, and no luminance.

    Both colours of a patch are brought to unit luminance; their ratios, cut to 0.5 to 2, are fitted by a polynomial of order 2 together with
    anchors that keep ratio 1. A node's colour is multiplied by its ratios and brought back to its own luminance.
    """
    luma = lambda cs: reduce(lambda a, b: a + b, (c * w for c, w in zip(cs, LUMA, strict=True)))
    least = lambda c: F.greatest(c, F.lit(1e-6))
    cut = lambda c: F.least(F.greatest(c, F.lit(0.5)), F.lit(2.0))
    s, t = luma([F.col(c) for c in "rgb"]), luma([F.col(f"t{c}") for c in "rgb"])
    ratios = patches.select("r", "g", "b", *[cut((F.col(f"t{c}") / least(t)) / least(F.col(c) / least(s))).alias(f"t{c}") for c in "rgb"])
    anchors = patches.sparkSession.createDataFrame([(*map(float, a), 1.0, 1.0, 1.0) for a in ANCHORS], "r double, g double, b double, tr double, tg double, tb double")
    of = {c: F.col(c) for c in "rgb"}
    terms = rgb_terms(2)
    rows = ratios.unionByName(anchors).select(*[_term(x, of).alias("".join(x)) for x in terms], "tr", "tg", "tb")
    weights = solve_channels(rows, ["".join(x) for x in terms])
    grid = lut_grid(patches.sparkSession, size).withColumn("lum", luma([F.col(c) for c in "rgb"]))
    grid = grid.withColumns({f"n{c}": F.col(c) / least(F.col("lum")) * cut(v) for c, v in zip("rgb", predicted(weights, of, 2), strict=True)})
    grid = grid.withColumn("out", luma([F.col(f"n{c}") for c in "rgb"]))
    value = lambda c: F.when((F.col("lum") < 1e-6) | (F.col("out") <= 1e-6), 0.0).otherwise(F.least(F.greatest(F.col(f"n{c}") * F.col("lum") / F.col("out"), F.lit(0.0)), F.lit(1.0)))
    return grid.select("ri", "gi", "bi", *[value(c).alias(f"v{c}") for c in "rgb"])
