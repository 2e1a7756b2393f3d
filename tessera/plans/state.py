"""Mutations, state machines and filters on state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.operators import mutations, predicates
from tessera.session import table as T

from .catalogue import query
from .common import FOLDER_SQL, fold, folder_of_url, gps_sql, with_gps


@query("upsert_merge", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_custkey, max_by(o_totalprice, o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    old = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = T(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    return mutations.upsert(old, new, ["id"])


@query("update_by_key", "WITH u AS (SELECT o_custkey, max(o_totalprice) AS b, CASE WHEN count(*) > 10 THEN 'MANY' END AS s FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE b END AS c_acctbal, CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE s END AS c_mktsegment FROM customer LEFT JOIN u ON o_custkey = c_custkey")
def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    old = T(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.when(F.count("*") > 10, "MANY").alias("c_mktsegment"))
    return mutations.update_by_key(old, new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query("merge_fill_overwrite", "WITH o AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 0 ELSE p_size END AS size, p_type FROM part), u AS (SELECT p_partkey AS id, p_size + 100 AS size, 'NEW' AS p_type FROM part WHERE p_partkey % 2 = 0) SELECT o.id, CASE WHEN u.id IS NOT NULL AND o.size = 0 THEN u.size ELSE o.size END AS size, coalesce(u.p_type, o.p_type) AS p_type FROM o LEFT JOIN u USING (id)")
def merge_fill_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    part = T(spark, sf, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size")).alias("size"), "p_type")
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).alias("size"), F.lit("NEW").alias("p_type"))
    return mutations.fill_or_overwrite(old, new, ["id"], {"size": F.lit(0)}, ["p_type"])


@query("merge_keys", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 3 ELSE o_custkey END AS o_custkey FROM orders")
def merge_keys(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.merge_keys(T(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 3, 7)


@query("batch_reassign", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 5 END ELSE o_custkey END AS o_custkey FROM orders")
def batch_reassign(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    moved = rows.where("o_orderkey % 10 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 20 != 0, F.lit(5)).cast("long").alias("o_custkey"))
    return mutations.update_by_key(rows, moved, ["o_orderkey"], ["o_custkey"])


@query("cascade_delete", "WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey NOT IN (FROM d) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM d)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    orders = T(spark, sf, "orders")
    gone = orders.where("o_orderstatus = 'P'").select("o_orderkey")
    lines = T(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    left = lambda df, name: df.join(gone, "o_orderkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return left(orders, "orders").union(left(lines, "lineitem"))


@query("relink_join", "WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 5)::INT AS state FROM orders), f AS (SELECT l_orderkey AS id, min(l_partkey)::VARCHAR AS path FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT id, path, 0 AS state FROM o JOIN f USING (id) WHERE state = 4")
def relink_join(spark: SparkSession, sf: str) -> DataFrame:
    found = T(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").cast("string").alias("path"))
    missing = T(spark, sf, "orders").where(f"o_orderkey % 5 = {mutations.MISSING}").select(F.col("o_orderkey").alias("id"))
    return missing.join(found, "id").select("id", "path", F.lit(mutations.LOCAL_ONLY).alias("state"))


@query("relocation_plan", "WITH p AS (SELECT event_id, strftime(ts, '%Y/%m/%d') AS target, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y/%m/%d') ELSE 'inbox' END AS now FROM events) SELECT event_id, now, target FROM p WHERE now <> target")
def relocation_plan(spark: SparkSession, sf: str) -> DataFrame:
    target = text.date_folder(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    plan = T(spark, sf, "events").select("event_id", target.alias("target")).withColumn("now", F.when(F.col("event_id") % 3 == 0, F.col("target")).otherwise("inbox"))
    return plan.where("now <> target").select("event_id", "now", "target")


STATE = "(o_orderkey % 5)::INT AS state"


@query("state_validate", f"WITH s AS (SELECT o_orderkey, {STATE}, o_orderkey % 3 = 0 AS present FROM orders) SELECT o_orderkey, CASE WHEN state = 3 THEN 3 WHEN NOT present THEN CASE WHEN state = 2 THEN 3 ELSE 4 END WHEN state = 4 THEN 0 ELSE state END AS state FROM s")
def state_validate(spark: SparkSession, sf: str) -> DataFrame:
    state = (F.col("o_orderkey") % 5).cast("int")
    return T(spark, sf, "orders").select("o_orderkey", mutations.validated_state(state, F.col("o_orderkey") % 3 == 0).cast("int").alias("state"))


@query("sync_full_outer", f"WITH l AS (SELECT o_orderkey AS id, {STATE} FROM orders WHERE o_orderkey % 7 <> 0), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O') SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 3 WHEN r.id IS NOT NULL AND state = 0 THEN 2 WHEN r.id IS NOT NULL AND state = 4 THEN 3 WHEN r.id IS NULL AND state = 2 THEN 0 ELSE state END AS state FROM l FULL JOIN r ON l.id = r.id")
def sync_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    local = T(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("state"))
    server = T(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"))
    return mutations.synced(local, server, "id", "state")


FILES = "f AS (SELECT p_partkey AS id, p_brand AS dir, p_name AS stem, (p_partkey % 3)::INT AS category, p_size AS size FROM part)"
STACKS = f"{FILES}, g AS (SELECT *, count(*) OVER w AS n, min(category) OVER w AS lo, max(category) OVER w AS hi, row_number() OVER (w ORDER BY category DESC, size DESC, id) AS r, first_value(id) OVER (w ORDER BY category DESC, size DESC, id) AS stack_id FROM f WINDOW w AS (PARTITION BY dir, stem)), s AS (SELECT id, stack_id, r = 1 AS stack_primary FROM g WHERE n >= 2 AND lo <> hi)"


def _stacks(spark: SparkSession, sf: str) -> DataFrame:
    files = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dir"), F.col("p_name").alias("stem"), (F.col("p_partkey") % 3).cast("int").alias("category"), F.col("p_size").alias("size"))
    return mutations.resolve_stacks(files, "id", ["dir", "stem"], "category", "size")


@query("stack_resolution", f"WITH {STACKS} SELECT * FROM s")
def stack_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _stacks(spark, sf)


@query("stack_companions", f"WITH {STACKS} SELECT id, count(*) OVER (PARTITION BY stack_id) AS members, nullif(CASE WHEN stack_primary THEN min(CASE WHEN NOT stack_primary THEN id END) OVER (PARTITION BY stack_id) ELSE stack_id END, -1) AS companion FROM s")
def stack_companions(spark: SparkSession, sf: str) -> DataFrame:
    per = Window.partitionBy("stack_id")
    first = F.min(F.when(~F.col("stack_primary"), F.col("id"))).over(per)
    return _stacks(spark, sf).select("id", F.count("*").over(per).alias("members"), F.when(F.col("stack_primary"), first).otherwise(F.col("stack_id")).alias("companion"))


@query("filter_not_shadowed", f"WITH {STACKS} SELECT p_partkey FROM part LEFT JOIN s ON s.id = p_partkey WHERE s.id IS NULL OR stack_primary")
def filter_not_shadowed(spark: SparkSession, sf: str) -> DataFrame:
    hidden = _stacks(spark, sf).where(~F.col("stack_primary")).select(F.col("id").alias("p_partkey"))
    return T(spark, sf, "part").select("p_partkey").join(hidden, "p_partkey", "left_anti")


@query("schema_migrate", "SELECT c_custkey AS id, c_name, 0 AS rating, '' AS memo FROM customer")
def schema_migrate(spark: SparkSession, sf: str) -> DataFrame:
    steps = [("rename", "c_custkey", "id", None), ("add", "rating", "int", 0), ("add", "memo", "string", ""), ("drop", "c_nationkey", "", None), ("drop", "c_acctbal", "", None), ("drop", "c_mktsegment", "", None)]
    return mutations.migrate(T(spark, sf, "customer"), steps)


@query("clamp_values", "SELECT event_id, least(greatest((value / 20)::DOUBLE - 2, 0), 5) AS rating, least(greatest((event_id % 7)::INT - 3, -1), 1) AS flag FROM events")
def clamp_values(spark: SparkSession, sf: str) -> DataFrame:
    clamp = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return T(spark, sf, "events").select("event_id", clamp(F.col("value") / 20 - 2, 0.0, 5.0).alias("rating"), clamp((F.col("event_id") % 7).cast("int") - 3, -1, 1).alias("flag"))


@query("apply_results", f"WITH s AS (SELECT o_orderkey AS id, {STATE} FROM orders), d AS (SELECT l_orderkey AS id, min(l_returnflag) = 'A' AS ok FROM lineitem GROUP BY 1) SELECT s.id, CASE WHEN state = 1 AND ok IS NOT NULL THEN CASE WHEN ok THEN 2 ELSE 0 END ELSE state END AS state FROM s LEFT JOIN d USING (id)")
def apply_results(spark: SparkSession, sf: str) -> DataFrame:
    states = T(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("state"))
    done = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.min("l_returnflag") == "A").alias("ok"))
    return states.join(done, "id", "left").select("id", predicates.state_after_upload(F.col("state"), F.col("ok")).alias("state"))


@query("retry_classify", "SELECT event_id, attempts, CASE WHEN event_type <> 'error' THEN 'done' WHEN attempts < 3 THEN 'retry' ELSE 'failed' END AS status, CASE WHEN event_type = 'error' AND attempts < 3 THEN 5 * attempts ELSE 0 END AS wait FROM (SELECT event_id, event_type, (event_id % 4)::INT AS attempts FROM events)")
def retry_classify(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.streaming import incremental

    rows = T(spark, sf, "events").withColumn("attempts", (F.col("event_id") % 4).cast("int"))
    status, wait = incremental.retry(F.col("event_type") == "error", F.col("attempts"))
    return rows.select("event_id", "attempts", status.alias("status"), wait.alias("wait"))


@query("scan_normalize_state", f"SELECT o_orderkey, CASE WHEN state = 1 THEN 0 ELSE state END AS state FROM (SELECT o_orderkey, {STATE} FROM orders)")
def scan_normalize_state(spark: SparkSession, sf: str) -> DataFrame:
    state = (F.col("o_orderkey") % 5).cast("int")
    return T(spark, sf, "orders").select("o_orderkey", predicates.loaded_state(state).alias("state"))


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "orders").where("o_orderkey = 42")


@query("rest_list_projection", "SELECT c_custkey, c_name, c_mktsegment, count(*) OVER () AS total FROM customer")
def rest_list_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


PHOTOS = """p AS (SELECT p_partkey AS id, p_partkey % 5 AS sync_state, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS local_path, p_size % 9 <> 0 AS present, p_brand IN ('Brand#1', 'Brand#2') AS is_raw, p_type = 'PROMO' AS is_video,
  CASE WHEN p_size % 3 = 0 THEN '{}' ELSE '' END AS lens, CASE WHEN p_size % 4 = 0 THEN '1/60 s' ELSE '' END AS exposure, CASE WHEN p_size % 5 = 0 THEN 6 ELSE 1 END AS orientation, CASE WHEN p_size % 6 = 0 THEN 35 ELSE 0 END AS focal,
  p_partkey % 11 * 100 AS width, p_partkey % 13 * 100 AS height, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'sp' END AS preview_path, p_partkey % 4 <> 0 AS preview_present, p_partkey % 2 = 0 AS face_scanned, p_partkey % 10 * 700 - 1400 AS as_shot FROM part)"""


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    """Photos with all kinds of missing parts, from the keys and sizes of parts."""
    k, n = F.col("p_partkey"), F.col("p_size")
    some = lambda test, value, other: F.when(test, value).otherwise(other)
    columns = {
        "id": k, "sync_state": k % 5, "local_path": some(n % 7 == 0, "", F.col("p_name")), "present": n % 9 != 0, "is_raw": F.col("p_brand").isin("Brand#1", "Brand#2"), "is_video": F.col("p_type") == "PROMO",
        "lens_correction_params": some(n % 3 == 0, "{}", ""), "exposure_time": some(n % 4 == 0, "1/60 s", ""), "orientation": some(n % 5 == 0, 6, 1), "focal_length_35mm": some(n % 6 == 0, 35, 0),
        "width": k % 11 * 100, "height": k % 13 * 100, "preview_path": some(k % 3 == 0, "", "sp"), "preview_present": k % 4 != 0, "face_scanned": k % 2 == 0, "as_shot_temp": k % 10 * 700 - 1400,
    }
    return T(spark, sf, "part").select(*[c.alias(name) for name, c in columns.items()])


@query("pending_filter", f"WITH {PHOTOS} SELECT id, local_path FROM p WHERE sync_state = 0 AND local_path <> ''")
def pending_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _photos(spark, sf).where(predicates.pending_upload()).select("id", "local_path")


@query("needs_backfill_filter", f"WITH {PHOTOS} SELECT id FROM p WHERE local_path <> '' AND present AND (lens = '' AND exposure = '' AND orientation = 1 AND focal = 0 OR width = 0 OR height = 0 OR is_raw AND lens = '')")
def needs_backfill_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _photos(spark, sf).where(predicates.needs_exif()).select("id")


@query("needs_work_flags", f"WITH {PHOTOS}, s AS (SELECT *, preview_path <> '' AND preview_present AS sp, local_path <> '' AND present AS f FROM p) SELECT id, NOT is_video AND NOT sp AND f AS preview, NOT is_video AND NOT face_scanned AND sp AS face, is_raw AND as_shot <= 0 AND f AS wb FROM s")
def needs_work_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _photos(spark, sf).select("id", predicates.needs_preview().alias("preview"), predicates.needs_faces().alias("face"), predicates.needs_white_balance().alias("wb"))


EDITS = "event_id % 4 / 8::DOUBLE AS x, 1 - event_id % 3 / 8::DOUBLE AS w, event_id % 5 AS turns, event_id % 7 / 2::DOUBLE AS v, event_id % 11 / 4::DOUBLE AS ev"


@query("sentinel_predicates", f"WITH g AS ({gps_sql('events', 'event_id')}), e AS (SELECT event_id, lat, lon, {EDITS} FROM g), f AS (SELECT event_id, lat <> 0 OR lon <> 0 AS has_gps, x <> 0 OR w <> 1 AS has_crop, turns <> 0 AS has_rotation, v <> 0 AS has_perspective, ev <> 0 AS dev FROM e) SELECT event_id, has_gps, has_crop, has_rotation, has_perspective, has_crop OR has_rotation OR has_perspective OR dev AS has_edits FROM f")
def sentinel_predicates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    neutral = predicates.CROP | predicates.ROTATION | predicates.PERSPECTIVE | predicates.DEVELOP
    set_ = {"user_crop_x": k % 4 / F.lit(8.0), "user_crop_w": 1 - k % 3 / F.lit(8.0), "user_rotation90": k % 5, "user_persp_v": k % 7 / F.lit(2.0), "dev_exposure": k % 11 / F.lit(4.0)}
    rows = with_gps(T(spark, sf, "events"), "event_id").withColumns({c: set_.get(c, F.lit(v)) for c, v in neutral.items()})
    return rows.select("event_id", geo.has_gps(F.col("lat"), F.col("lon")).alias("has_gps"), predicates.has_crop().alias("has_crop"), predicates.has_rotation().alias("has_rotation"), predicates.has_perspective().alias("has_perspective"), predicates.has_edits().alias("has_edits"))


@query("snapshot_diff", "SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 4 = 0 AND c_acctbal <> 0")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = T(spark, sf, "customer")
    new = old.withColumns({"c_name": F.when(F.col("c_custkey") % 9 == 0, "changed").otherwise(F.col("c_name")), "c_acctbal": F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal"))})
    return mutations.changed_keys(old, new, "c_custkey")


@query("grid_filter_all", f"WITH g AS ({gps_sql('documents', 'doc_id')}) SELECT doc_id FROM g WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND (lat <> 0 OR lon <> 0) AND lat BETWEEN -60 AND 60 AND lon BETWEEN -170 AND 170 AND starts_with(source, 'src1') AND text <> '' AND contains({fold('text')}, 'the')")
def grid_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.search import grid_filter

    rows = with_gps(T(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    chosen = T(spark, sf, "labels").where("quality = 1").select("doc_id")
    return grid_filter(rows, "doc_id", ids=chosen, bbox=(-60, -170, 60, 170), folder=("source", "src1"), text=(["text"], "the")).select("doc_id")


@query("prefix_filter", f"SELECT page_id FROM pages WHERE starts_with({FOLDER_SQL}, '/th')")
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").where(folder_of_url().startswith("/th")).select("page_id")


@query("collision_suffix", "WITH r AS (SELECT p_partkey, p_brand, p_name || '.jpg' AS name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, CASE WHEN n = 0 THEN name ELSE regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 1) || '-' || n || '.jpg' END AS target FROM r")
def collision_suffix(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(".jpg")).alias("name"))
    return mutations.suffixed(rows, "p_brand", "name", "p_partkey").select("p_partkey", "target")


@query("stream_foreach_upsert", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1")
def stream_foreach_upsert(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.streaming import incremental

    return incremental.latest_per_user(spark, f"{sf}/events.parquet")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.streaming import incremental

    return incremental.first_seen(spark, f"{sf}/events.parquet", ["user_id", "event_type"])
