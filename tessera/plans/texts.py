"""Text, path, JSON and display functions on columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import table as T

from .catalogue import query
from .common import fold

NAMES = "CASE p_partkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.arw' WHEN 2 THEN '.Mov' WHEN 3 THEN '.xyz' WHEN 4 THEN '.NEF' ELSE '' END"


def _part_ext():
    k = F.col("p_partkey") % 6
    return F.when(k == 0, ".JPG").when(k == 1, ".arw").when(k == 2, ".Mov").when(k == 3, ".xyz").when(k == 4, ".NEF").otherwise("")


@query("text_fields_search", f"SELECT p_partkey FROM part WHERE (p_name <> '' AND contains({fold('p_name')}, 'red')) OR (p_brand <> '' AND contains({fold('p_brand')}, 'red')) OR (p_type <> '' AND contains({fold('p_type')}, 'red'))")
def text_fields_search(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "part").where(text.any_field_contains(["p_name", "p_brand", "p_type"], "ReD")).select("p_partkey")


@query("ascii_lower_contains", f"SELECT doc_id, contains({fold('text')}, 'être') AS hit FROM documents")
def ascii_lower_contains(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "documents").select("doc_id", text.ascii_lower("text").contains("être").alias("hit"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem FROM pages")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").select("page_id", text.parent_dir("url").alias("dir"), text.file_name("url").alias("name"), text.extension("url").alias("ext"), text.stem("url").alias("stem"))


@query("path_join", "SELECT p_partkey, '/vol/' || p_brand || '/' || p_name || '.jpg' AS path FROM part")
def path_join(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "part").select("p_partkey", text.join_path(F.lit("/vol/"), F.concat("p_brand", F.lit("/")), F.concat("p_name", F.lit(".jpg"))).alias("path"))


@query("classify_extension", f"""
WITH e AS (SELECT p_partkey, {NAMES} AS ext FROM part)
SELECT p_partkey, CASE lower(ext) WHEN '.jpg' THEN 'image' WHEN '.arw' THEN 'raw' WHEN '.nef' THEN 'raw' WHEN '.mov' THEN 'video' ELSE '' END AS class, ext IN ('.arw', '.NEF') AS exact_raw FROM e""")
def classify_extension(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "part").select("p_partkey", _part_ext().alias("ext"))
    return rows.select("p_partkey", text.media_class("ext").alias("class"), text.exact_case_raw(F.regexp_replace("ext", r"^\.", "")).alias("exact_raw"))


@query("parse_at_tokens", r"""
WITH q AS (SELECT p_partkey, p_name || ' @' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' @last one' ELSE '' END AS q FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'last' ELSE regexp_extract(q, '@([^ ]+)', 1) END AS location, CASE WHEN p_partkey % 3 = 0 THEN regexp_extract(q, '^([^@]*) @', 1) || ' one' ELSE regexp_extract(q, '^([^@]*) @', 1) END AS text FROM q""")
def parse_at_tokens(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("p_partkey") % 3 == 0, " @last one").otherwise("")
    asked = T(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" @"), "p_brand", more).alias("q"))
    return asked.select("p_partkey", text.location_of("q").alias("location"), text.text_of("q").alias("text"))


MODELS = "CASE p_partkey % 8 WHEN 0 THEN 'ILCE-7M3' WHEN 1 THEN 'Canon EOS R5' WHEN 2 THEN 'NIKON Z 6' WHEN 3 THEN 'X-T4' WHEN 4 THEN 'DMC-G9' WHEN 5 THEN 'E-M1' WHEN 6 THEN 'PENTAX K-1' ELSE p_name END"


@query("case_prefix_rules", f"WITH m AS (SELECT p_partkey, {MODELS} AS m FROM part) SELECT p_partkey, CASE WHEN m LIKE 'ILCE%' THEN 'SONY' WHEN m LIKE 'Canon%' THEN 'Canon' WHEN m LIKE 'NIKON%' THEN 'NIKON CORPORATION' WHEN m LIKE 'X-%' THEN 'FUJIFILM' WHEN m LIKE 'DMC-%' THEN 'Panasonic' WHEN m LIKE 'E-M%' THEN 'OLYMPUS' WHEN m LIKE '%PENTAX%' THEN 'RICOH IMAGING COMPANY, LTD.' ELSE '' END AS maker FROM m")
def case_prefix_rules(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ILCE-7M3", "Canon EOS R5", "NIKON Z 6", "X-T4", "DMC-G9", "E-M1", "PENTAX K-1"]
    model = F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8).cast("int")), F.col("p_name"))
    return T(spark, sf, "part").select("p_partkey", text.maker_of(model).alias("maker"))


@query("whitelist_map", "SELECT p_partkey, CASE WHEN c IN ('Red', 'Blue', 'Green', 'Yellow', 'Purple') THEN c ELSE '' END AS label FROM (SELECT p_partkey, upper(p_name[1]) || regexp_extract(p_name[2:], '^[^ ]*') AS c FROM part)")
def whitelist_map(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "part").select("p_partkey", text.color_label(F.initcap(text.before_space("p_name"))).alias("label"))


@query("html_unescape_ws", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS clean FROM pages")
def html_unescape_ws(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "pages").select("page_id", text.clean_text("html").alias("clean"))


@query("kv_extract", r"""
WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'CurveRefine' ELSE '' END || 'Saturation = ' || value || chr(10) || 'Contrast2012 = +15' AS t FROM events)
SELECT event_id, try_cast(regexp_extract(regexp_extract(t, '(?s)(?:^|[\n\r\t ])Saturation(.*)$', 1), '^[ \t=]*([+-]?[0-9.]+)', 1) AS DOUBLE) AS saturation, 15::DOUBLE AS contrast FROM t""")
def kv_extract(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("event_id") % 3 == 0, "CurveRefine").otherwise("")
    rows = T(spark, sf, "events").select("event_id", F.concat(head, F.lit("Saturation = "), F.col("value").cast("string"), F.lit("\nContrast2012 = +15")).alias("t"))
    return rows.select("event_id", text.key_value("t", "Saturation").alias("saturation"), text.key_value("t", "Contrast2012").alias("contrast"))


@query("substring_before", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head FROM part")
def substring_before(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "part").select("p_partkey", text.before_space("p_name").alias("head"))


@query("priority_pick", "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'Town' ELSE '' END AS town, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' and a long name of a state' ELSE '' END AS state FROM customer), t AS (SELECT c_custkey, concat_ws(', ', coalesce(nullif(city, ''), nullif(town, '')), nullif(state, ''), 'Land') AS t FROM p) SELECT c_custkey, CASE WHEN length(t) > 50 THEN t[1:50] || '...' ELSE t END AS place FROM t")
def priority_pick(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit("")
    city, town = F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 0, "Town").otherwise("")
    state = F.when(k % 5 == 0, F.concat("c_name", F.lit(" and a long name of a state"))).otherwise("")
    return T(spark, sf, "customer").select("c_custkey", text.place_name(city, town, none, none, state, F.lit("Land")).alias("place"))


@query("display_format", "SELECT event_id, repeat('*', (event_id % 7 < 5 AND true)::INT * (event_id % 7)::INT + (event_id % 7 >= 5)::INT * 5) || repeat('.', 5 - least(event_id % 7, 5)::INT) AS stars, 'a, b' AS tags, (event_id * 1048576 / 2)::BIGINT // 1048576 || CASE WHEN event_id % 2 = 1 THEN '.5 MB' ELSE '.0 MB' END AS size FROM events")
def display_format(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return T(spark, sf, "events").select("event_id", text.stars((k % 7).cast("int")).alias("stars"), text.tags_text(F.lit('["a","b"]')).alias("tags"), text.megabytes(k * 1048576 / F.lit(2.0)).alias("size"))


@query("pad_truncate", "WITH t AS (SELECT doc_id, range(10, 10 + doc_id % 90)[1:63] AS ids FROM documents) SELECT doc_id, array_to_string(list_concat(list_append(ids, 1), list_resize([]::BIGINT[], 63 - len(ids), 0)), ' ') AS ids, (len(ids) + 1)::INT AS attended FROM t")
def pad_truncate(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("doc_id") % 90).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(10), F.lit(9) + n)).otherwise(F.array().cast("array<int>"))
    rows = T(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    attended = F.aggregate(text.attention_mask("ids"), F.lit(0), lambda s, x: s + x)
    return rows.select("doc_id", F.array_join(text.pad_tokens("ids").cast("array<string>"), " ").alias("ids"), attended.alias("attended"))


@query("json_roundtrip", "SELECT event_id, event_type, coalesce(value, 0) AS value, 0 AS rating FROM events")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    coded = T(spark, sf, "events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("j"))
    got = coded.select("event_id", F.from_json("j", "event_type string, value double, rating int").alias("x"))
    return got.select("event_id", F.coalesce("x.event_type", F.lit("")).alias("event_type"), F.coalesce("x.value", F.lit(0.0)).alias("value"), F.coalesce("x.rating", F.lit(0)).alias("rating"))


@query("json_default", "SELECT event_id, coalesce((props ->> '$.k')::INT, 0) AS k, coalesce(props ->> '$.missing', 'none') AS missing FROM events")
def json_default(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda path, default: F.coalesce(F.get_json_object("props", path), F.lit(default))
    return T(spark, sf, "events").select("event_id", get("$.k", "0").cast("int").alias("k"), get("$.missing", "none").alias("missing"))


@query("json_variant", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sony' ELSE 'fuji' END AS type, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS knots, CASE WHEN event_id % 2 = 0 THEN round(1 + (event_id % 100) / 16384::DOUBLE, 8) ELSE (event_id % 100)::DOUBLE END AS first FROM events")
def json_variant(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("event_id") % 100).cast("string")
    sony = F.concat(F.lit('{"type":"sony","dist":['), k, F.lit(',2,3]}'))
    fuji = F.concat(F.lit('{"type":"fuji","knots":[0,1],"dist":['), k, F.lit(',5]}'))
    rows = T(spark, sf, "events").select("event_id", F.from_json(F.when(F.col("event_id") % 2 == 0, sony).otherwise(fuji), "type string, dist array<double>, knots array<double>").alias("x"))
    first = F.get("x.dist", F.lit(0))
    return rows.select("event_id", "x.type", F.when(F.col("x.type") == "fuji", F.size("x.knots")).otherwise(F.size("x.dist")).alias("knots"), F.when(F.col("x.type") == "sony", F.round(first / 16384 + 1, 8)).otherwise(first).alias("first"))


@query("plane_average", "SELECT event_id, round((value + value * 2 + 5) / 3, 6) AS mean FROM events")
def plane_average(spark: SparkSession, sf: str) -> DataFrame:
    planes = F.slice(F.array(F.col("value"), F.col("value") * 2, F.lit(5.0), F.lit(1e9)), 1, 3)
    return T(spark, sf, "events").select("event_id", F.round(F.aggregate(planes, F.lit(0.0), lambda s, x: s + x) / F.size(planes), 6).alias("mean"))


@query("coalesce_fallback_chain", "SELECT event_id, coalesce(nullif(event_id % 2, 0), nullif(event_id % 3, 0), nullif(event_id % 5, 0), -1) AS v FROM events")
def coalesce_fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: F.nullif(F.col("event_id") % n, F.lit(0))
    return T(spark, sf, "events").select("event_id", F.coalesce(part(2), part(3), part(5), F.lit(-1)).alias("v"))
