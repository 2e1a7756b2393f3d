"""Derived relations that several queries share: positions, boxes and folders made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def with_gps(df: DataFrame, key: str) -> DataFrame:
    """lat and lon from a key; every fifth row has none, which is (0, 0)."""
    k = F.col(key)
    none = k % 5 == 4
    return df.withColumn("lat", F.when(none, 0.0).otherwise((k * 7919 % 1400) / F.lit(10.0) - 70)).withColumn("lon", F.when(none, 0.0).otherwise((k * 104729 % 3600) / F.lit(10.0) - 180))


def gps_sql(table: str, key: str) -> str:
    return f"SELECT *, CASE WHEN {key} % 5 = 4 THEN 0::DOUBLE ELSE ({key} * 7919 % 1400) / 10::DOUBLE - 70 END AS lat, CASE WHEN {key} % 5 = 4 THEN 0::DOUBLE ELSE ({key} * 104729 % 3600) / 10::DOUBLE - 180 END AS lon FROM {table}"


def with_box(df: DataFrame, key: str, prefix: str, salt: int) -> DataFrame:
    """x, y, w, h between 0 and 1 from a key."""
    part = lambda m, n: ((F.col(key) * m + salt) % n) / F.lit(1000.0)
    return df.withColumns({f"{prefix}x": part(37, 600), f"{prefix}y": part(53, 600), f"{prefix}w": part(71, 300) + 0.05, f"{prefix}h": part(89, 300) + 0.05})


def box_sql(key: str, prefix: str, salt: int) -> str:
    part = lambda m, n: f"(({key} * {m} + {salt}) % {n}) / 1000::DOUBLE"
    return f"{part(37, 600)} AS {prefix}x, {part(53, 600)} AS {prefix}y, {part(71, 300)} + 0.05::DOUBLE AS {prefix}w, {part(89, 300)} + 0.05::DOUBLE AS {prefix}h"


def folder_of_url(url: str = "url"):
    """The host and folders of a url as a path: /host/a for http://host/a/b?c."""
    bare = F.regexp_replace(F.col(url), r"^[a-z]+:/|[?#].*$", "")
    return text.parent_dir(bare)


FOLDER_SQL = r"regexp_extract(regexp_replace(url, '^[a-z]+:/|[?#].*$', '', 'g'), '^(.*)/[^/]*$', 1)"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(column: str) -> str:
    return FOLD.format(column)
