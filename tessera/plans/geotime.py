"""Positions, boxes and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import ranking, timeline
from tessera.session import table as T

from .catalogue import query
from .common import box_sql, gps_sql, with_box, with_gps

G = f"g AS ({gps_sql('events', 'event_id')})"
TOKYO = (35.6812, 139.7671)
HALF = "pow(sin(radians({1} - {0}) / 2), 2)"
H = f"({HALF.format(TOKYO[0], 'lat')} + cos(radians({TOKYO[0]})) * cos(radians(lat)) * {HALF.format(TOKYO[1], 'lon')})"
KM = f"2 * 6371::DOUBLE * atan2(sqrt({H}), sqrt(1 - {H}))"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return with_gps(T(spark, sf, "events"), "event_id")


def _km():
    return geo.haversine_km(F.lit(TOKYO[0]), F.lit(TOKYO[1]), F.col("lat"), F.col("lon"))


@query("haversine_km", f"WITH {G} SELECT event_id, round({KM}, 4) AS km FROM g")
def haversine_km(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", F.round(_km(), 4).alias("km"))


@query("geo_bbox_filter", f"WITH {G} SELECT event_id, lat, lon FROM g WHERE (lat <> 0 OR lon <> 0) AND lat BETWEEN -10 AND 20.5 AND lon BETWEEN -30 AND 60")
def geo_bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where(geo.in_bbox(F.col("lat"), F.col("lon"), -10, -30, 20.5, 60)).select("event_id", "lat", "lon")


@query("geo_radius_topk", f"WITH {G}, d AS (SELECT event_id, {KM} AS km FROM g WHERE (lat <> 0 OR lon <> 0) AND event_id <> 0) SELECT event_id, round(km, 4) AS km, round(1 / (1 + km / 2), 6) AS score FROM d WHERE km <= 3000 ORDER BY round(km, 4), event_id LIMIT 25")
def geo_radius_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A band of latitudes, pushed to where positions are made, then the distance and a top-n limit."""
    band = 3000 / 111.0
    near = _events(spark, sf).where(geo.has_gps(F.col("lat"), F.col("lon")) & F.col("lat").between(TOKYO[0] - band, TOKYO[0] + band) & (F.col("event_id") != 0))
    found = near.withColumn("exact", _km()).where("exact <= 3000").withColumn("km", F.round("exact", 4))
    return found.orderBy("km", "event_id").limit(25).select("event_id", "km", F.round(geo.distance_score(F.col("exact")), 6).alias("score"))


MERCATOR = "(lon + 180) / 360 * 256 * pow(2, {z}) AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2, {z}) AS y"


@query("mercator_xy", f"WITH {G}, m AS (SELECT event_id, {MERCATOR.format(z='event_id % 4')} FROM g) SELECT event_id, round(x, 4) AS x, round(y, 4) AS y FROM m")
def mercator_xy(spark: SparkSession, sf: str) -> DataFrame:
    zoom = F.col("event_id") % 4
    return _events(spark, sf).select("event_id", F.round(geo.mercator_x(F.col("lon"), zoom), 4).alias("x"), F.round(geo.mercator_y(F.col("lat"), zoom), 4).alias("y"))


@query("mercator_inverse", "SELECT event_id, round((event_id % 1024) / 1024::DOUBLE * 360 - 180, 6) AS lon, round(degrees(atan((exp(z) - exp(-z)) / 2)), 6) + 0.0 AS lat FROM (SELECT event_id, pi() * (1 - 2 * (event_id % 1000 + 12) / 1024::DOUBLE) AS z FROM events)")
def mercator_inverse(spark: SparkSession, sf: str) -> DataFrame:
    x, y, zoom = F.col("event_id") % 1024, F.col("event_id") % 1000 + 12, F.lit(2.0)
    return T(spark, sf, "events").select("event_id", F.round(geo.mercator_lon(x, zoom), 6).alias("lon"), (F.round(geo.mercator_lat(y, zoom), 6) + 0.0).alias("lat"))


@query("grid_cluster", f"WITH {G}, m AS (SELECT event_id, lat, lon, {MERCATOR.format(z='1')} FROM g WHERE lat <> 0 OR lon <> 0) SELECT floor(x / 24)::BIGINT AS gx, floor(y / 24)::BIGINT AS gy, count(*) AS n, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, min(event_id) AS representative FROM m GROUP BY 1, 2")
def grid_cluster(spark: SparkSession, sf: str) -> DataFrame:
    placed = _events(spark, sf).where(geo.has_gps(F.col("lat"), F.col("lon"))).select("event_id", geo.mercator_x(F.col("lon"), F.lit(1)).alias("x"), geo.mercator_y(F.col("lat"), F.lit(1)).alias("y"))
    cells = placed.groupBy(F.floor(F.col("x") / 24).alias("gx"), F.floor(F.col("y") / 24).alias("gy"))
    return cells.agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), F.min("event_id").alias("representative"))


@query("bbox_fit", f"""
WITH {G}, b AS (SELECT user_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM g WHERE (lat <> 0 OR lon <> 0) GROUP BY 1),
z AS (SELECT *, unnest(range(1, 19)) AS zoom FROM b)
SELECT user_id, round((s + n) / 2, 6) AS mid_lat, round((w + e) / 2, 6) AS mid_lon, coalesce(max(zoom) FILTER ((e - w) / 360 * 256 * pow(2, zoom) <= 0.8 * 1024), 1)::INT AS zoom FROM z GROUP BY user_id, s, n, w, e""")
def bbox_fit(spark: SparkSession, sf: str) -> DataFrame:
    some = _events(spark, sf).where(geo.has_gps(F.col("lat"), F.col("lon")))
    box = some.groupBy("user_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    fits = F.filter(F.sequence(F.lit(1), F.lit(18)), lambda z: (F.col("e") - F.col("w")) / 360 * 256 * F.pow(F.lit(2.0), z) <= 0.8 * 1024)
    return box.select("user_id", F.round((F.col("s") + F.col("n")) / 2, 6).alias("mid_lat"), F.round((F.col("w") + F.col("e")) / 2, 6).alias("mid_lon"), F.coalesce(F.array_max(fits), F.lit(1)).alias("zoom"))


@query("bbox_min_span", "WITH b AS (SELECT c_custkey, c_acctbal / 1000 AS s, c_acctbal / 1000 + (c_custkey % 10) / 100::DOUBLE AS n FROM customer) SELECT c_custkey, round(CASE WHEN n - s < 0.05 THEN (s + n) / 2 - 0.05 ELSE s END, 6) AS south, round(CASE WHEN n - s < 0.05 THEN (s + n) / 2 + 0.05 ELSE n END, 6) AS north FROM b")
def bbox_min_span(spark: SparkSession, sf: str) -> DataFrame:
    box = T(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("s"), (F.col("c_acctbal") / 1000 + (F.col("c_custkey") % 10) / F.lit(100.0)).alias("n"))
    south, north = geo.least_span(F.col("s"), F.col("n"), 0.05)
    return box.select("c_custkey", F.round(south, 6).alias("south"), F.round(north, 6).alias("north"))


BOTH = "greatest(0, least(ax + aw, cx + cw) - greatest(ax, cx)) * greatest(0, least(ay + ah, cy + ch) - greatest(ay, cy))"
BOXES = ("ax", "ay", "aw", "ah", "cx", "cy", "cw", "ch")


@query("box_iou", f"WITH b AS (SELECT event_id, {box_sql('event_id', 'a', 0)}, {box_sql('event_id', 'c', 211)} FROM events), i AS (SELECT *, {BOTH} AS i FROM b) SELECT event_id, round(i / (aw * ah + cw * ch - i), 6) AS iou, round(i / least(aw * ah, cw * ch), 6) AS overlap FROM i")
def box_iou(spark: SparkSession, sf: str) -> DataFrame:
    boxes = with_box(with_box(T(spark, sf, "events"), "event_id", "a", 0), "event_id", "c", 211)
    cols = [F.col(c) for c in BOXES]
    return boxes.select("event_id", F.round(geo.iou(*cols), 6).alias("iou"), F.round(geo.overlap(*cols), 6).alias("overlap"))


MATCH = f"""
WITH a AS (SELECT event_id, user_id, {box_sql('event_id', 'a', 0)} FROM events WHERE event_type IN ('click', 'purchase')), b AS (SELECT event_id AS other_id, user_id, {box_sql('event_id', 'c', 57)} FROM events WHERE event_type NOT IN ('click', 'purchase')),
o AS (SELECT event_id, other_id, ({BOTH}) / least(aw * ah, cw * ch) AS o FROM a JOIN b USING (user_id))
SELECT event_id, max_by(other_id, (round(o, 6), -other_id)) AS other_id, max(round(o, 6)) AS overlap FROM o WHERE o > 0.5 GROUP BY 1"""


@query("box_best_match", MATCH)
def box_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """New boxes against all those known of the same user."""
    events = T(spark, sf, "events")
    own = F.col("event_type").isin("click", "purchase")
    a = with_box(events.where(own).select("event_id", "user_id"), "event_id", "a", 0)
    b = with_box(events.where(~own).select("event_id", "user_id"), "event_id", "c", 57).withColumnRenamed("event_id", "other_id")
    return ranking.best_overlap(a, b, ["user_id"], "event_id", "other_id", BOXES, 0.5)


@query("area_topk", f"WITH b AS (SELECT event_id, user_id, {box_sql('event_id', '', 0)} FROM events), r AS (SELECT user_id, event_id, round(w * h, 6) AS area, row_number() OVER (PARTITION BY user_id ORDER BY round(w * h, 6) DESC, event_id) AS rn FROM b) SELECT * FROM r WHERE rn <= 3")
def area_topk(spark: SparkSession, sf: str) -> DataFrame:
    boxes = with_box(T(spark, sf, "events").select("event_id", "user_id"), "event_id", "", 0).select("user_id", "event_id", F.round(F.col("w") * F.col("h"), 6).alias("area"))
    return ranking.top_per_key(boxes, ["user_id"], [F.desc("area"), "event_id"], 3).withColumn("rn", F.col("rn").cast("long"))


@query("nms_greedy")
def nms_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one user's events of one type stand for one image's detections."""
    events = T(spark, sf, "events").withColumn("image", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    boxes = with_box(events.select("image", F.col("event_id").alias("id"), F.col("value").alias("score")), "id", "", 0)
    return ranking.greedy_nms(boxes, "image").select("image", "id", "score")


@query("anchor_grid", "SELECT s AS stride, y * s AS cy, x * s AS cx, a AS anchor FROM (SELECT unnest([8, 16, 32]) AS s), LATERAL (SELECT unnest(range(0, 640 // s)) AS y), LATERAL (SELECT unnest(range(0, 640 // s)) AS x), (SELECT unnest([0, 1]) AS a)")
def anchor_grid(spark: SparkSession, sf: str) -> DataFrame:
    strides = spark.createDataFrame([(8,), (16,), (32,)], "stride int")
    side = F.sequence(F.lit(0), (F.lit(640) / F.col("stride")).cast("int") - 1)
    cells = strides.select("stride", F.explode(side).alias("y")).select("stride", "y", F.explode(side).alias("x"))
    return cells.select("stride", (F.col("y") * F.col("stride")).cast("long").alias("cy"), (F.col("x") * F.col("stride")).cast("long").alias("cx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("anchor"))


@query("timeline_neighbors", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM events), c AS (SELECT r AS c FROM r WHERE event_id = 77) SELECT event_id, (r - c)::INT AS \"offset\" FROM r, c WHERE r BETWEEN c - 15 AND c + 15")
def timeline_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.neighbours(T(spark, sf, "events").select("event_id", "ts"), "event_id", "ts", 77, 15).select("event_id", F.col("offset").cast("int").alias("offset"))


S = "e AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS t FROM g)"
ASOF = f"""
WITH {G}, {S}, k AS (SELECT user_id, t, lat, lon FROM e WHERE event_type = 'view' AND (lat <> 0 OR lon <> 0)), w AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'),
p AS (SELECT w.event_id, w.t, k.t AS pt, k.lat AS plat, k.lon AS plon FROM w ASOF LEFT JOIN k ON w.user_id = k.user_id AND w.t >= k.t),
n AS (SELECT w.event_id, k.t AS nt, k.lat AS nlat, k.lon AS nlon FROM w ASOF LEFT JOIN k ON w.user_id = k.user_id AND w.t <= k.t),
b AS (SELECT *, CASE WHEN nt = pt THEN 0.5 ELSE (t - pt) / (nt - pt) END AS s FROM p JOIN n USING (event_id)),
m AS (SELECT event_id, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt - pt < 86400 THEN plat + s * (nlat - plat) END WHEN nt - t < 3600 THEN nlat WHEN t - pt < 3600 THEN plat END AS m_lat,
  CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt - pt < 86400 THEN plon + s * (nlon - plon) END WHEN nt - t < 3600 THEN nlon WHEN t - pt < 3600 THEN plon END AS m_lon FROM b)"""


def _asof(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    kind = F.col("event_type")
    known, wanted = (kind == "view") & geo.has_gps(F.col("lat"), F.col("lon")), kind == "click"
    return timeline.asof_within(events.where(kind.isin("view", "click")), ["user_id"], "event_id", "t", "lat", "lon", known, wanted)


@query("asof_interpolate", f"{ASOF} SELECT event_id, round(m_lat, 5) AS m_lat, round(m_lon, 5) AS m_lon FROM m WHERE m_lat IS NOT NULL")
def asof_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf).select("event_id", F.round("m_lat", 5).alias("m_lat"), F.round("m_lon", 5).alias("m_lon"))


@query("asof_match_count", f"{ASOF} SELECT count(m_lat) AS n FROM m")
def asof_match_count(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf).agg(F.count("*").alias("n"))


GAP = f"""
WITH {G}, {S}, k AS (SELECT user_id, t, lat, lon, lag(t) OVER v AS t2, lag(lat) OVER v AS lat2, lead(t) OVER v AS t3, lead(lat) OVER v AS lat3 FROM e WHERE lat <> 0 OR lon <> 0 WINDOW v AS (PARTITION BY user_id ORDER BY t)),
w AS (SELECT event_id, user_id, t FROM e WHERE NOT (lat <> 0 OR lon <> 0)),
p AS (SELECT w.event_id, w.t, k.t AS pt, k.lat AS plat, k.t2 AS p2t, k.lat2 AS p2lat FROM w ASOF LEFT JOIN k ON w.user_id = k.user_id AND w.t >= k.t),
n AS (SELECT w.event_id, k.t AS nt, k.lat AS nlat, k.t3 AS n2t, k.lat3 AS n2lat FROM w ASOF LEFT JOIN k ON w.user_id = k.user_id AND w.t <= k.t),
b AS (SELECT *, t - pt AS back, nt - t AS ahead FROM p JOIN n USING (event_id))"""


def _gaps(spark: SparkSession, sf: str, both: float, one: float) -> DataFrame:
    events = _events(spark, sf).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "lat", "lon")
    return timeline.gap_fill(events, ["user_id"], "t", "lat", "lon", geo.has_gps(F.col("lat"), F.col("lon")), both, one)


@query("gap_interpolate", f"{GAP} SELECT event_id, round(CASE WHEN nt = pt THEN (plat + nlat) / 2 ELSE plat + (t - pt) / (nt - pt) * (nlat - plat) END, 5) AS lat FROM b WHERE back <= 360000 AND ahead <= 360000")
def gap_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf, 360000, 7200).where("how = 'between'").select("event_id", F.round("lat", 5).alias("lat"))


@query("gap_extrapolate", f"""{GAP}
SELECT event_id, CASE WHEN back <= 7200 AND ahead <= 7200 THEN 'between' WHEN back <= 36000 THEN 'after' ELSE 'before' END AS how,
  round(CASE WHEN back <= 7200 AND ahead <= 7200 THEN CASE WHEN nt = pt THEN (plat + nlat) / 2 ELSE plat + (t - pt) / (nt - pt) * (nlat - plat) END
    WHEN back <= 36000 THEN CASE WHEN p2t IS NULL OR p2t = pt THEN plat ELSE plat + (plat - p2lat) / (pt - p2t) * (t - pt) END
    ELSE CASE WHEN n2t IS NULL OR n2t = nt THEN nlat ELSE nlat + (nlat - n2lat) / (nt - n2t) * (t - nt) END END, 4) AS lat
FROM b WHERE back <= 7200 AND ahead <= 7200 OR back <= 36000 OR ahead <= 36000""")
def gap_extrapolate(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf, 7200, 36000).select("event_id", "how", F.round("lat", 4).alias("lat"))


@query("parse_exif_time", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch(date_trunc('second', ts))::BIGINT END AS t FROM events")
def parse_exif_time(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions import text

    shown = F.when(F.col("event_id") % 7 == 0, "2024:05").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return T(spark, sf, "events").select("event_id", text.exif_seconds(shown).alias("t"))


@query("iso_to_exif", "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS exif FROM events")
def iso_to_exif(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions import text

    return T(spark, sf, "events").select("event_id", text.iso_to_exif(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("exif"))


@query("date_subdir", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE strftime(ts, '%Y/%m/%d') END AS folder FROM events")
def date_subdir(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions import text

    shown = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return T(spark, sf, "events").select("event_id", text.date_folder(shown).alias("folder"))
