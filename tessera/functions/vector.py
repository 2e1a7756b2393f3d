"""Vector functions on array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product, the cosine of unit vectors; 0 for vectors that are empty or of unequal length."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(_col(a)) == F.size(_col(b))) & (F.size(_col(a)) > 0), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str, least: float = 1e-8) -> Column:
    """Unit vector; one shorter than ``least`` stays as it is."""
    n = norm(v)
    return F.transform(_col(v), lambda x: F.when(n > least, x.cast("double") / n).otherwise(x.cast("double")))


def projection(v: Column | str, dims: int = 8) -> Column:
    """Sum of the first dimensions, a cheap one-dimensional order."""
    return F.aggregate(F.slice(_col(v), 1, dims), F.lit(0.0), lambda s, x: s + x.cast("double"))
