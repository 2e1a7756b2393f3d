"""Vector search, hybrid and related scoring, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo, vector
from tessera.operators import clustering, ranking, search
from tessera.session import table

from .catalogue import query
from .common import gps_sql, with_gps

CENTRE = 7
DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
SCORED = f"s AS (SELECT e.vec_id, {DOT.format('e', 'c')} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = {CENTRE}) c WHERE e.vec_id <> {CENTRE})"
CUT = "k AS (SELECT vec_id, score FROM s, (SELECT max(score) AS top, max(score) - min(score) AS spread FROM s) WHERE spread <= 0.03 OR score >= top - 0.35 * spread)"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similarity_to(_vectors(spark, sf_dir), "vec_id", "embedding", CENTRE)


@query("vector_topk", f"WITH {SCORED} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_similar(_vectors(spark, sf_dir), "vec_id", "embedding", CENTRE, 20).withColumn("score", F.round("score", 6))


@query("cosine_pairs", f"SELECT a.vec_id, b.vec_id AS other_id, round({DOT.format('a', 'b')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _vectors(spark, sf_dir).select("vec_id", "embedding")
    b = a.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"), (F.col("vec_id") - 1).alias("vec_id"))
    return a.join(b, "vec_id").select("vec_id", "other_id", F.round(vector.dot("embedding", "other"), 6).alias("score"))


@query("l2_normalize", f"""
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7 + 1)) AS v FROM embeddings),
n AS (SELECT vec_id, v, {NORM.format('v')} AS n FROM v)
SELECT vec_id, round(CASE WHEN n > 1e-8 THEN v[1] / n ELSE v[1] END, 6) AS first, round(CASE WHEN n > 1e-8 THEN 1 ELSE n END, 6)::DOUBLE AS norm FROM n""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1)).alias("v"))
    unit = scaled.select("vec_id", vector.l2_normalize("v").alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(vector.norm("u"), 6).alias("norm"))


CENTROIDS = """
x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, sum(v) AS s FROM x GROUP BY 1, 2),
c AS (SELECT label, pos, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS v FROM m)"""


@query("vector_centroid", f"WITH {CENTROIDS} SELECT label, pos, round(v, 6) AS value FROM c")
def vector_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.centroids(_vectors(spark, sf_dir), "label", "embedding")
    return found.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query("centroid_best_match", f"""
WITH {CENTROIDS}, l AS (SELECT label, list(v ORDER BY pos) AS c FROM c GROUP BY label),
p AS (SELECT vec_id, l.label, list_dot_product(e.embedding::DOUBLE[], l.c) AS s FROM embeddings e, l),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM p)
SELECT vec_id, label AS best_label, round(s, 6) AS score FROM r WHERE k = 1 AND s > 0.1""")
def centroid_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = clustering.best_centroid(vectors.select("vec_id", "embedding"), "embedding", clustering.centroids(vectors, "label", "embedding"), "label", 0.1)
    return found.select("vec_id", F.col("label").alias("best_label"), F.round("score", 6).alias("score"))


@query("projection_sort", "WITH p AS (SELECT vec_id, list_sum(embedding[1:8]::DOUBLE[]) AS p FROM embeddings) SELECT vec_id, round(p, 6) AS projection, row_number() OVER (ORDER BY round(p, 6), vec_id) AS rank FROM p")
def projection_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.round(vector.projection("embedding"), 6).alias("projection"))
    return ranking.global_rank(rows, ["projection", "vec_id"])


@query("embedding_lookup", "SELECT vec_id, label, len(embedding)::INT AS dims FROM embeddings WHERE vec_id = 42 AND label IS NOT NULL")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id = 42 and label is not null").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("embedding_cache_semi", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def embedding_cache_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return _vectors(spark, sf_dir).select("vec_id", "label").join(visible, "vec_id", "left_semi")


@query("scan_not_null", "SELECT vec_id, coalesce(label, 0) AS label FROM embeddings WHERE embedding IS NOT NULL")
def scan_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("embedding is not null").select("vec_id", F.coalesce("label", F.lit(0)).alias("label"))


@query("spread_cutoff", f"WITH {SCORED}, {CUT} SELECT vec_id, round(score, 6) AS score FROM k")
def spread_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.spread_cutoff(_scored(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


@query("hybrid_search", f"""
WITH {SCORED}, {CUT},
t AS (SELECT doc_id AS vec_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license')),
o AS (SELECT t.vec_id, coalesce((SELECT max(score) FROM k) + 0.01, 1::DOUBLE) AS score, 0 AS g, (-t.vec_id)::DOUBLE AS o FROM t WHERE t.vec_id NOT IN (SELECT vec_id FROM k)),
u AS (SELECT * FROM o UNION ALL SELECT vec_id, score, 1, -score FROM k)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY g, o, vec_id) AS rank FROM u""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_vector = search.spread_cutoff(_scored(spark, sf_dir))
    docs = table(spark, sf_dir, "documents")
    by_text = docs.where(search.text_or(["text"], "license")).select(F.col("doc_id").alias("vec_id"))
    return search.hybrid_merge(by_vector, by_text, "vec_id", "vec_id").withColumn("score", F.round("score", 6))


def _km(a: str, b: str) -> str:
    half = lambda x, y: f"pow(sin(radians({y} - {x}) / 2), 2)"
    h = f"({half(f'{a}.lat', f'{b}.lat')} + cos(radians({a}.lat)) * cos(radians({b}.lat)) * {half(f'{a}.lon', f'{b}.lon')})"
    return f"2 * 6371::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h}))"


@query("related_scoring", f"""
WITH {SCORED}, g AS ({gps_sql('embeddings', 'vec_id')}), z AS (SELECT * FROM g WHERE vec_id = {CENTRE}),
a AS (SELECT g.vec_id, s.score AS sim, g.label = z.label AS shared, CASE WHEN g.lat <> 0 OR g.lon <> 0 THEN {_km('z', 'g')} END AS km FROM g JOIN s USING (vec_id), z),
v AS (SELECT vec_id, 0.70 * sim + 0.15 * shared::INT + coalesce(0.15 / (1 + km / 2), 0) AS score, CASE WHEN coalesce(0.15 / (1 + km / 2), 0) > 0.70 * sim + 0.15 * shared::INT THEN 'geo' ELSE 'vector' END AS route FROM (SELECT * FROM a ORDER BY sim DESC, vec_id LIMIT 40)),
n AS (SELECT vec_id, 0.15 / (1 + km / 2) + 0.15 * shared::INT AS score, 'geo' AS route FROM a WHERE km <= 5000 AND vec_id NOT IN (SELECT vec_id FROM v) ORDER BY km, vec_id LIMIT 5),
q AS (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT (SELECT 20 - count(*) FROM n))
SELECT vec_id, round(score, 6) AS score, route FROM (SELECT * FROM q UNION ALL SELECT * FROM n)""")
def related_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_gps(_vectors(spark, sf_dir), "vec_id").withColumn("gps", geo.has_gps(F.col("lat"), F.col("lon")))
    centre = placed.where(F.col("vec_id") == CENTRE).select(F.col("embedding").alias("ce"), F.col("label").alias("cl"), F.col("lat").alias("cy"), F.col("lon").alias("cx"))
    near = F.when(F.col("gps"), geo.haversine_km(F.col("cy"), F.col("cx"), F.col("lat"), F.col("lon")))
    pairs = placed.where(F.col("vec_id") != CENTRE).crossJoin(F.broadcast(centre.limit(1)))
    rows = pairs.select("vec_id", vector.dot("embedding", "ce").alias("sim"), (F.col("label") == F.col("cl")).alias("shared"), near.alias("km"))
    return search.related(rows, "vec_id", candidates=40, slots=20, geo_slots=5, most_km=5000).select("vec_id", F.round("score", 6).alias("score"), "route")


@query("greedy_cluster")
def greedy_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; each is in one cluster at most."""
    return clustering.greedy_centroid(_vectors(spark, sf_dir), "vec_id", "embedding", threshold=0.30)


@query("people_groups")
def people_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from 5 on stand for persons, nations for their names, of which every third has none."""
    faces = _vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") % 100).alias("photo"), F.when(F.col("label") >= 5, F.col("label")).alias("person"), "embedding")
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    groups, _, _ = clustering.people(faces, names, "vec_id", "photo", "person", "embedding", threshold=0.30)
    return groups


@query("cluster_distinct_photos", "SELECT label, count(DISTINCT vec_id % 100) AS photos, count(*) AS members FROM embeddings GROUP BY label")
def cluster_distinct_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.countDistinct(F.col("vec_id") % 100).alias("photos"), F.count("*").alias("members"))


@query("cluster_order", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, row_number() OVER (ORDER BY label >= 5 DESC, CASE WHEN label >= 5 THEN n END DESC NULLS LAST, label) AS rank FROM c")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("label") >= 5
    counts = _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return ranking.global_rank(counts, [named.desc(), F.when(named, F.col("n")).desc_nulls_last(), F.col("label")]).select("label", "n", "rank")


@query("group_representative", "SELECT label, min(vec_id) AS representative, count(*) AS n FROM embeddings GROUP BY label")
def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.min_by("vec_id", "vec_id").alias("representative"), F.count("*").alias("n"))
