"""Joins, sets, aggregates, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import hierarchy, layout, mutations, ranking
from tessera.session import table as T
from tessera.workspace import new_folder

from .catalogue import query
from .common import FOLDER_SQL, folder_of_url


@query("missing_anti_join", "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') ON o_custkey = c_custkey WHERE o_custkey IS NULL")
def missing_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = T(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return T(spark, sf, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("semi_join_id_set", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_id_set(spark: SparkSession, sf: str) -> DataFrame:
    ids = T(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T(spark, sf, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(T(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_intersection", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).intersect(T(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("insert_ignore", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT k, min(n) FROM (SELECT o_custkey + 700 AS k, o_orderpriority AS n FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY k")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    old = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = T(spark, sf, "orders").groupBy((F.col("o_custkey") + 700).alias("id")).agg(F.min("o_orderpriority").alias("name"))
    return mutations.insert_ignore(old, new, ["id"])


@query("ingest_new_only", "WITH n AS (SELECT p_name || '_' || p_size AS id, min(p_partkey) AS first_key FROM part GROUP BY 1) SELECT id, first_key FROM n WHERE id NOT IN (SELECT p_name || '_' || p_size FROM part WHERE p_partkey % 3 = 0)")
def ingest_new_only(spark: SparkSession, sf: str) -> DataFrame:
    files = T(spark, sf, "part").withColumn("id", F.concat_ws("_", "p_name", F.col("p_size").cast("string")))
    return files.groupBy("id").agg(F.min("p_partkey").alias("first_key")).join(files.where("p_partkey % 3 = 0").select("id"), "id", "left_anti")


@query("names_by_photo", "SELECT l_orderkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def names_by_photo(spark: SparkSession, sf: str) -> DataFrame:
    """Each key pair once before the names are joined: narrow rows of two numbers are all that is deduplicated."""
    pairs = T(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    named = pairs.join(T(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return named.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))


@query("keywords_to_json", "SELECT l_orderkey, '[' || string_agg(DISTINCT '\"' || p_name || '\"', ',' ORDER BY '\"' || p_name || '\"') || ']' AS tags FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1")
def keywords_to_json(spark: SparkSession, sf: str) -> DataFrame:
    words = T(spark, sf, "lineitem").join(T(spark, sf, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    return words.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set("p_name"))).alias("tags"))


@query("collections_with_counts", "SELECT n_nationkey, n_name, coalesce(c, 0)::BIGINT AS members FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def collections_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = T(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return T(spark, sf, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("c", F.lit(0)).cast("long").alias("members"))


@query("left_join_coalesce", "SELECT o_orderkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def left_join_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    people = T(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return T(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"))


@query("left_join_on_predicate", "SELECT o_orderkey, count(l_orderkey) AS picked, max(s_name) AS name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def left_join_on_predicate(spark: SparkSession, sf: str) -> DataFrame:
    lines = T(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    picked = T(spark, sf, "orders").join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_returnflag") == "R"), "left")
    named = picked.join(T(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return named.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("picked"), F.max("s_name").alias("name"))


STAR = """
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN region cr ON cr.r_regionkey = cn.n_regionkey
LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN region sr ON sr.r_regionkey = sn.n_regionkey WHERE l_returnflag = 'A'"""


@query("star_join_9", f"SELECT cr.r_name AS customer_region, sr.r_name AS supplier_region, p_type, count(*) AS n, round(sum(l_quantity), 2) AS quantity {STAR} GROUP BY 1, 2, 3")
def star_join_9(spark: SparkSession, sf: str) -> DataFrame:
    """Facts joined with four tables by key and with the small ones, each twice; the optimizer broadcasts what is small."""
    lines = T(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    places = T(spark, sf, "nation").join(T(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    of = lambda key, name: places.select(F.col("n_nationkey").alias(key), F.col("r_name").alias(name))
    customers = T(spark, sf, "customer").join(of("c_nationkey", "customer_region"), "c_nationkey", "left").select("c_custkey", "customer_region")
    suppliers = T(spark, sf, "supplier").join(of("s_nationkey", "supplier_region"), "s_nationkey", "left").select("s_suppkey", "supplier_region")
    orders = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = T(spark, sf, "part").select("p_partkey", "p_type")
    star = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("c_custkey") == F.col("o_custkey")).join(parts, F.col("p_partkey") == F.col("l_partkey")).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return star.groupBy("customer_region", "supplier_region", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("id_remap_inner", "SELECT o_orderkey, c_custkey * 10 AS new_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY'")
def id_remap_inner(spark: SparkSession, sf: str) -> DataFrame:
    ids = T(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 10).alias("new_key"))
    return T(spark, sf, "orders").join(ids, "o_custkey").select("o_orderkey", "new_key")


@query("group_count_desc", "SELECT p_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY 1")
def group_count_desc(spark: SparkSession, sf: str) -> DataFrame:
    counts = T(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return ranking.global_rank(counts, [F.desc("n"), "p_name"])


@query("global_count", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def global_count(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("select_distinct", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3")
def select_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "lineitem").where("l_suppkey = 3").select("l_orderkey").distinct()


FOLDERS = f"f AS (SELECT {FOLDER_SQL} AS path, count(*) AS n FROM pages GROUP BY 1)"
ANCESTORS = "p AS (SELECT path, n, string_split(path, '/') AS s FROM f), a AS (SELECT path, n, array_to_string(s[1:k], '/') AS a FROM (SELECT *, unnest(range(2, greatest(len(s), 2) + 1)) AS k FROM p))"


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").groupBy(folder_of_url().alias("path")).agg(F.count("*").alias("n"))


@query("folder_counts", f"WITH {FOLDERS} SELECT * FROM f")
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _folders(spark, sf)


@query("folder_ancestors", f"WITH {FOLDERS}, {ANCESTORS} SELECT DISTINCT path, a AS ancestor FROM a")
def folder_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return _folders(spark, sf).select("path", F.explode(hierarchy.ancestors("path")).alias("ancestor")).distinct()


@query("folder_rollup", f"WITH {FOLDERS}, {ANCESTORS} SELECT a AS path, sum(CASE WHEN a = path THEN n ELSE 0 END)::BIGINT AS own, sum(n)::BIGINT AS total, (len(string_split(a, '/')) - 1)::INT AS depth FROM a GROUP BY a")
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.rollup_folders(_folders(spark, sf), "path", "n")


@query("nearest_ancestor", f"WITH {FOLDERS} SELECT x.path, (SELECT max(y.path) FROM f y WHERE starts_with(x.path, y.path || '/')) AS parent FROM f x")
def nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.nearest_ancestor(_folders(spark, sf), "path")


TREE = "t AS (SELECT r_regionkey + 1000 AS id, r_name AS name, NULL::INT AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey + 1000 FROM nation UNION ALL SELECT c_custkey + 100000, c_name, c_nationkey FROM customer)"


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    top = T(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent"))
    mid = T(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", (F.col("n_regionkey") + 1000).cast("long"))
    low = T(spark, sf, "customer").select(F.col("c_custkey") + 100000, "c_name", F.col("c_nationkey").cast("long"))
    return top.union(mid).union(low)


@query("tree_parent_join", f"WITH {TREE} SELECT x.id, y.name AS parent_name, y.id IS NULL AS is_root FROM t x LEFT JOIN t y ON y.id = x.parent")
def tree_parent_join(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    up = tree.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"))
    return tree.join(up, F.col("parent") == F.col("pid"), "left").select("id", "parent_name", F.col("pid").isNull().alias("is_root"))


@query("hierarchy_levels", f"WITH RECURSIVE {TREE}, r AS (SELECT id, 1 AS level, id::VARCHAR AS trail FROM t WHERE parent IS NULL UNION ALL SELECT t.id, level + 1, trail || '/' || t.id FROM r JOIN t ON t.parent = r.id WHERE level < 10) SELECT * FROM r")
def hierarchy_levels(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.with_levels(_tree(spark, sf), "id", "parent", most=10).select("id", "level", F.array_join("trail", "/").alias("trail"))


@query("tree_preorder", f"WITH RECURSIVE {TREE}, r AS (SELECT id, name AS k FROM t WHERE parent IS NULL UNION ALL SELECT t.id, k || '/' || t.name FROM r JOIN t ON t.parent = r.id) SELECT id, row_number() OVER (ORDER BY k, id) AS rank FROM r")
def tree_preorder(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    named = hierarchy.with_levels(tree.select(F.struct("name", "id").alias("key"), F.col("id"), "name", "parent"), "id", "parent")
    names = tree.select(F.col("id").cast("string").alias("sid"), "name")
    steps = named.select("id", F.posexplode("trail").alias("pos", "sid")).join(names, "sid")
    paths = steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "/").alias("k"))
    return ranking.global_rank(paths, ["k", "id"]).select("id", "rank")


@query("etl_stats", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS still_open, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def etl_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("still_open"),
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_linenumber").alias("total"),
    )


@query("histogram_3d", "SELECT (l_quantity::INT % 12)::INT AS h, floor(l_discount * 39.9)::INT AS s, floor(l_tax * 49.9)::INT AS v, count(*) AS n, count(*) < 50 AS sparse FROM lineitem GROUP BY 1, 2, 3")
def histogram_3d(spark: SparkSession, sf: str) -> DataFrame:
    bins = T(spark, sf, "lineitem").select((F.round("l_quantity").cast("int") % 12).alias("h"), F.floor(F.col("l_discount") * 39.9).cast("int").alias("s"), F.floor(F.col("l_tax") * 49.9).cast("int").alias("v"))
    return bins.groupBy("h", "s", "v").agg(F.count("*").alias("n"), (F.count("*") < 50).alias("sparse"))


@query("fit_error", "WITH e AS (SELECT l_returnflag AS channel, l_extendedprice - 1000 * l_quantity AS d FROM lineitem) SELECT channel, round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse FROM e GROUP BY 1")
def fit_error(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_extendedprice") - 1000 * F.col("l_quantity")
    errors = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), d.alias("d"))
    return errors.groupBy("channel").agg(F.round(F.avg(F.abs("d")), 4).alias("mae"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 4).alias("rmse"))


@query("sigma_clip_fit")
def sigma_clip_fit(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.fitting import sigma_clipped

    rows = T(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), F.lit(1.0).alias("one"), "l_quantity", (F.col("l_quantity") * F.col("l_quantity") / 50).alias("q2"))
    return sigma_clipped(rows, "y", ["one", "l_quantity", "q2"])


@query("box_mean_var", """
WITH g AS (SELECT user_id, event_id, value::DOUBLE AS v FROM events)
SELECT event_id, round(avg(v) OVER w, 5) AS mean, round(avg(v * v) OVER w - avg(v) OVER w * avg(v) OVER w, 3) + 0.0 AS var FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def box_mean_var(spark: SparkSession, sf: str) -> DataFrame:
    box = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 3)
    mean, square = F.avg("value").over(box), F.avg(F.col("value") * F.col("value")).over(box)
    return T(spark, sf, "events").select("event_id", F.round(mean, 5).alias("mean"), (F.round(square - mean * mean, 3) + 0.0).alias("var"))


@query("group_pairs_by_key", "WITH r AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS k FROM part WHERE p_size >= 25 GROUP BY ALL), j AS (SELECT p_name, min(p_partkey) AS jpg FROM part WHERE p_size < 5 GROUP BY 1) SELECT p_brand, p_type, count(*) AS files, count(jpg) AS paired FROM r LEFT JOIN j USING (p_name) GROUP BY ALL")
def group_pairs_by_key(spark: SparkSession, sf: str) -> DataFrame:
    part = T(spark, sf, "part")
    raw = part.where("p_size >= 25").groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("k"))
    jpg = part.where("p_size < 5").groupBy("p_name").agg(F.min("p_partkey").alias("jpg"))
    return raw.join(jpg, "p_name", "left").groupBy("p_brand", "p_type").agg(F.count("*").alias("files"), F.count("jpg").alias("paired"))


@query("null_aware_classify", "WITH c AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 3 END AS system_only, n_name FROM nation) SELECT n_nationkey, CASE WHEN contains(n_name, '1') THEN 1 WHEN contains(n_name, '2') THEN 2 ELSE 0 END AS type FROM c WHERE system_only <> 1 OR system_only IS NULL")
def null_aware_classify(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    rows = T(spark, sf, "nation").withColumn("system_only", F.when(k != 0, k)).where("system_only <> 1 or system_only is null")
    return rows.select("n_nationkey", F.when(F.col("n_name").contains("1"), 1).when(F.col("n_name").contains("2"), 2).otherwise(0).alias("type"))


@query("library_sort", "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y:%m:%d') END AS d, o_orderpriority AS f FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY d = '', d DESC, f, o_orderkey) AS rank FROM p")
def library_sort(spark: SparkSession, sf: str) -> DataFrame:
    dated = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd")).alias("date"), F.col("o_orderpriority").alias("filename"))
    return ranking.global_rank(dated, [*ranking.library_order(), "o_orderkey"]).select("o_orderkey", "rank")


@query("limit_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT greatest(count(*) - 1000, 0) FROM orders) AS remaining FROM orders ORDER BY o_orderkey LIMIT 1000")
def limit_with_total(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.limit_with_total(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


MEMBERS = "m AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")) - 1
    return T(spark, sf, "customer").select("c_nationkey", "c_custkey", place.cast("long").alias("position"))


@query("collection_members", f"WITH {MEMBERS} SELECT n_name, c_custkey, position FROM m JOIN nation ON n_nationkey = c_nationkey")
def collection_members(spark: SparkSession, sf: str) -> DataFrame:
    """The members of each collection, by name, in their order."""
    named = T(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return _members(spark, sf).join(named, "c_nationkey").select("n_name", "c_custkey", "position")


@query("position_assign", f"WITH {MEMBERS}, l AS (SELECT c_nationkey, count(*) AS n FROM m GROUP BY 1), a AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p FROM supplier) SELECT s_nationkey, s_suppkey, p + coalesce(n, 0) AS position FROM a LEFT JOIN l ON c_nationkey = s_nationkey")
def position_assign(spark: SparkSession, sf: str) -> DataFrame:
    """New members go behind those that are there, in order of insertion."""
    last = T(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    own = T(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("p"))
    return own.join(last, "s_nationkey", "left").select("s_nationkey", "s_suppkey", (F.col("p") + F.coalesce("n", F.lit(0))).cast("long").alias("position"))


PRICED = "r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.global_rank(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "rank")


def _by_price(spark: SparkSession, sf: str) -> layout.Ordered:
    orders = T(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return layout.write_in_order(orders, [F.desc("o_totalprice"), "o_orderkey"], new_folder(spark, "ordered"))


@query("page_window", f"WITH {PRICED} SELECT * FROM r WHERE rank > 40 - 2 * 5 AND rank <= 80 + 2 * 5")
def page_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 41 to 80 in view, in a grid of five columns, and two grid rows more on either side."""
    return layout.page(_by_price(spark, sf), first=40, end=80, columns=5, margin=2).select("o_orderkey", "rank")


@query("load_more", f"WITH {PRICED} SELECT o_orderkey, rank, (SELECT greatest(count(*) - 1200, 0) FROM orders) AS remaining FROM r WHERE rank > 1000 AND rank <= 1200")
def load_more(spark: SparkSession, sf: str) -> DataFrame:
    """After the first thousand rows two hundred more, and how many are left."""
    return layout.more_rows(_by_price(spark, sf), 1000, 200).select("o_orderkey", "rank", "remaining")


@query("rank_range", f"WITH {PRICED}, e AS (SELECT min(rank) AS a, max(rank) AS b FROM r WHERE o_orderkey IN (7, 300)) SELECT o_orderkey, rank FROM r, e WHERE rank BETWEEN a AND b")
def rank_range(spark: SparkSession, sf: str) -> DataFrame:
    """All rows from one chosen row to another, both included, whichever comes first."""
    return ranking.between_rows(_priced(spark, sf), "o_orderkey", 7, 300)


@query("minmax_normalize", "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS share FROM orders")
def minmax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    orders = T(spark, sf, "orders")
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return orders.crossJoin(F.broadcast(ends)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("share"))


@query("last_n_per_key", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def last_n_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_per_key(T(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@query("in_list_ordered", "WITH i AS (SELECT unnest(range(0, 50)) AS pos), k AS (SELECT pos, pos * 7919 % 20000 AS k FROM i) SELECT pos, o_orderkey, o_totalprice FROM k JOIN orders ON o_orderkey = k")
def in_list_ordered(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 7919 % 20000).alias("o_orderkey"))
    return T(spark, sf, "orders").join(F.broadcast(asked), "o_orderkey").select("pos", "o_orderkey", "o_totalprice")


@query("in_list_distinct", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (1, 5, 9, 42, 77)")
def in_list_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "lineitem").where(F.col("l_partkey").isin(1, 5, 9, 42, 77)).select("l_orderkey").distinct()


SHARES = "n AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)"


@query("arrays_overlap_flag", f"WITH {SHARES} SELECT a.l_orderkey, len(list_intersect(a.s, b.s)) > 0 AS shares FROM n a JOIN n b ON b.l_orderkey = a.l_orderkey + 1")
def arrays_overlap_flag(spark: SparkSession, sf: str) -> DataFrame:
    named = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    other = named.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("t"))
    return named.join(other, "l_orderkey").select("l_orderkey", F.arrays_overlap("s", "t").alias("shares"))


@query("array_exists_contains", f"WITH m AS (SELECT l_orderkey, list(DISTINCT s_name) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) SELECT l_orderkey FROM m WHERE len(list_filter(s, lambda x: contains(lower(x), '00001'))) > 0")
def array_exists_contains(spark: SparkSession, sf: str) -> DataFrame:
    named = T(spark, sf, "lineitem").join(T(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set("s_name").alias("s"))
    return named.where(F.exists("s", lambda x: F.lower(x).contains("00001"))).select("l_orderkey")


@query("fallback_lookup_join", "WITH p AS (SELECT p_brand, p_type, min(p_partkey) AS path FROM part WHERE p_size > 40 GROUP BY ALL), d AS (SELECT p_brand, min(p_partkey) AS path FROM part WHERE p_size = 1 GROUP BY ALL) SELECT p_partkey, coalesce(p.path, d.path, -1) AS path FROM part LEFT JOIN p USING (p_brand, p_type) LEFT JOIN d USING (p_brand)")
def fallback_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    part = T(spark, sf, "part")
    exact = part.where("p_size > 40").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("exact"))
    default = part.where("p_size = 1").groupBy("p_brand").agg(F.min("p_partkey").alias("default"))
    return part.join(exact, ["p_brand", "p_type"], "left").join(default, "p_brand", "left").select("p_partkey", F.coalesce("exact", "default", F.lit(-1)).alias("path"))


@query("dedupe_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
