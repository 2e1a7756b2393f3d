"""As-of matching and gap filling of time series.

Series are matched within a key and time buckets. Each bucket gets the last known row of those before it and the first of
those after it, told from one row a bucket, so that no task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def neighbours(df: DataFrame, key: str, time: str, centre_id, n: int) -> DataFrame:
    """Up to n rows before and after one row in order of (time, key), and itself, with their offset; by two top-n limits, not a global window."""
    centre = df.where(F.col(key) == centre_id).select(F.col(time).alias("__t"), F.col(key).alias("__k")).limit(1)
    both = df.crossJoin(F.broadcast(centre))
    place = F.struct(time, key)
    at = F.struct(F.col("__t").alias(time), F.col("__k").alias(key))
    before = both.where(place < at).orderBy(F.desc(time), F.desc(key)).limit(n).withColumn("offset", -F.row_number().over(Window.orderBy(F.desc(time), F.desc(key))))
    after = both.where(place >= at).orderBy(time, key).limit(n + 1).withColumn("offset", F.row_number().over(Window.orderBy(time, key)) - 1)
    return before.unionByName(after).drop("__t", "__k")


BUCKET = 86_400.0  # seconds of a series that one task sorts


def _so_far(column: str | Column, rows: WindowSpec, own: bool = False) -> Column:
    """The last known value up to this row, or before it; a growing frame, so linear in the rows."""
    frame = rows.rangeBetween(Window.unboundedPreceding, Window.currentRow) if own else rows.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(column, ignorenulls=True).over(frame)


def _around(rows: DataFrame, keys: list[str], time: str, known: Column, values: list[str], bucket: float, further: bool = False) -> DataFrame:
    """``rows`` with p and n: the nearest known (t, *values) at or before, and at or after, in the same key; ``further`` adds to each as ``far`` the known one beyond it.

    Rows are shuffled once, by key and bucket. What a bucket takes from others comes from a table of one row a bucket, joined on the same
    columns. The key is one struct: never null, so that the join and the windows ask for the same partitioning. What comes after a row is
    what came before it in falling order: a frame to the end of the bucket would be read anew for each row.
    """
    part = rows.withColumns({"__g": F.struct(*keys), "__b": F.floor(F.col(time) / bucket), "__at": F.when(known, F.struct(F.col(time).alias("t"), *values))})
    up, down = (Window.partitionBy("__g", "__b").orderBy(o) for o in (F.col(time), F.col(time).desc()))
    rise, fall = (Window.partitionBy("__g").orderBy(o) for o in (F.col("__b"), F.col("__b").desc()))  # one row a bucket

    edges = part.select("__g", "__b", "__at", time)
    seen = F.col("__at")
    if further:
        edges = edges.withColumn("__p2", _so_far("__at", up)).withColumn("__n2", _so_far("__at", down))
        ends = {"__last": F.max(F.when(seen.isNotNull(), F.struct(seen.alias("at"), F.col("__p2").alias("far")))), "__first": F.min(F.when(seen.isNotNull(), F.struct(seen.alias("at"), F.col("__n2").alias("far"))))}
    else:
        ends = {"__last": F.max(F.struct(seen.alias("at"))), "__first": F.min(F.when(seen.isNotNull(), F.struct(seen.alias("at"))))}
    per = edges.groupBy("__g", "__b").agg(*[c.alias(n) for n, c in ends.items()])
    for end, way, name in (("__last", rise, "__before"), ("__first", fall, "__after")):
        if further:  # the only known row of a bucket has its next one in another bucket
            per = per.withColumn("__o", _so_far(f"{end}.at", way))
            whole = F.when(F.col(f"{end}.at").isNotNull(), F.struct(F.col(f"{end}.at").alias("at"), F.coalesce(F.col(f"{end}.far"), F.col("__o")).alias("far")))
            per = per.withColumn(end, whole).withColumn(name, _so_far(end, way)).drop("__o")
        else:
            per = per.withColumn(name, F.struct(_so_far(f"{end}.at", way).alias("at")))

    found = part.join(per.select("__g", "__b", "__before", "__after"), ["__g", "__b"])
    for way, carried, name in ((up, "__before", "p"), (down, "__after", "n")):
        nearest = F.coalesce(_so_far("__seen", way, own=True), F.col(carried))
        if further:
            found = found.withColumn("__o", F.coalesce(_so_far("__at", way), F.col(f"{carried}.at")))
            found = found.withColumn("__seen", F.when(seen.isNotNull(), F.struct(seen.alias("at"), F.col("__o").alias("far"))))
        else:
            found = found.withColumn("__seen", F.when(seen.isNotNull(), F.struct(seen.alias("at"))))
        fields = ["t", *values]
        found = found.withColumn("__o", nearest).withColumn(name, F.struct(*[F.col(f"__o.at.{f}").alias(f) for f in fields], *([F.col("__o.far").alias("far")] if further else [])))
    return found.drop("__g", "__b", "__at", "__before", "__after", "__seen", "__o")


def _between(field: str, time: str) -> Column:
    total = F.col("n.t") - F.col("p.t")
    share = F.when(total == 0, 0.5).otherwise((F.col(time) - F.col("p.t")) / total)
    return F.col(f"p.{field}") + share * (F.col(f"n.{field}") - F.col(f"p.{field}"))


def asof_interpolate(targets: DataFrame, track: DataFrame, keys: list[str], key: str, time: str, lat: str, lon: str, edge: float = 3600, gap: float = 86400, bucket: float = BUCKET) -> DataFrame:
    """Targets (keys, key, time) with a position from the track (keys, time, lat, lon), by the rule of ``asof_within``."""
    points = track.select(*keys, F.col(time).cast("double").alias(time), lat, lon, F.lit(None).cast(targets.schema[key].dataType).alias(key), F.lit(True).alias("__known"))
    wanted = targets.select(*keys, F.col(time).cast("double").alias(time), F.lit(None).cast("double").alias(lat), F.lit(None).cast("double").alias(lon), key, F.lit(False).alias("__known"))
    return asof_within(points.unionByName(wanted), keys, key, time, lat, lon, F.col("__known"), ~F.col("__known"), edge, gap, bucket)


def asof_within(rows: DataFrame, keys: list[str], key: str, time: str, lat: str, lon: str, known: Column, wanted: Column, edge: float = 3600, gap: float = 86400, bucket: float = BUCKET) -> DataFrame:
    """The ``wanted`` rows of one table with a position (m_lat, m_lon) from its ``known`` rows; those that have none are left out.

    Linear between the two neighbouring points if these are less than ``gap`` apart; a target outside the track takes
    the end point if less than ``edge`` away; both bounds are strict. Known rows of times <= 0 are dropped, targets at time 0 and rows
    of a null time too. A row that is both finds itself. Of known rows at one time any may stand; give distinct times for a defined result.
    """
    known, wanted = known & (F.col(time) > 0), wanted & (F.col(time) != 0)
    own = rows.select(*keys, key, F.col(time).cast("double").alias(time), lat, lon, F.coalesce(known, F.lit(False)).alias("__k"), F.coalesce(wanted, F.lit(False)).alias("__w")).where("__k or __w")
    found = _around(own, keys, time, F.col("__k"), [lat, lon], bucket).where("__w")
    inside = F.col("p.t").isNotNull() & F.col("n.t").isNotNull() & (F.col("n.t") - F.col("p.t") < gap)
    early = F.col("p.t").isNull() & (F.col("n.t") - F.col(time) < edge)
    late = F.col("n.t").isNull() & (F.col(time) - F.col("p.t") < edge)
    value = lambda f: F.when(inside, _between(f, time)).when(early, F.col(f"n.{f}")).when(late, F.col(f"p.{f}"))
    return found.select(*keys, key, time, value(lat).alias("m_lat"), value(lon).alias("m_lon")).where(F.col("m_lat").isNotNull())


def gap_fill(rows: DataFrame, keys: list[str], time: str, lat: str, lon: str, known: Column, both_sides: float = 7200, one_side: float = 1800, bucket: float = BUCKET) -> DataFrame:
    """Rows without a position, filled from their own series; all bounds are inclusive.

    With known neighbours on both sides within ``both_sides``: linear (the middle if they coincide). Else from the one before within
    ``one_side``: on along the line through it and the one before that, or at it if there is none; else likewise from the one after.
    """
    own = rows.withColumn("__known", F.coalesce(known, F.lit(False)))
    found = _around(own, keys, time, F.col("__known"), [lat, lon], bucket, further=True).where(~F.col("__known"))
    t = F.col(time)
    back, ahead = t - F.col("p.t"), F.col("n.t") - t
    both = (back <= both_sides) & (ahead <= both_sides)

    def beyond(side: str, field: str) -> Column:
        span = F.col(f"{side}.t") - F.col(f"{side}.far.t")
        slope = (F.col(f"{side}.{field}") - F.col(f"{side}.far.{field}")) / span
        return F.when(F.col(f"{side}.far.t").isNull() | (span == 0), F.col(f"{side}.{field}")).otherwise(F.col(f"{side}.{field}") + slope * (t - F.col(f"{side}.t")))

    value = lambda f: F.when(both, _between(f, time)).when(back <= one_side, beyond("p", f)).when(ahead <= one_side, beyond("n", f))
    how = F.when(both, "between").when(back <= one_side, "after").when(ahead <= one_side, "before")
    keep = [c for c in rows.columns if c not in (lat, lon)]
    return found.select(*keep, value(lat).alias(lat), value(lon).alias(lon), how.alias("how")).where("how is not null")
