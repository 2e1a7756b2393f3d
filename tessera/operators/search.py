"""Similarity search, cut-offs, hybrid merges and related-item scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators.ranking import global_rank


def similarity_to(vectors: DataFrame, key: str, vec: str, centre_id) -> DataFrame:
    """(key, score): similarity of all other rows to one; nothing if that row is missing. One row is broadcast."""
    centre = vectors.where(F.col(key) == centre_id).select(F.col(vec).alias("__c")).limit(1)
    return vectors.where(F.col(key) != centre_id).crossJoin(F.broadcast(centre)).select(key, vector.dot(vec, "__c").alias("score"))


def top_similar(vectors: DataFrame, key: str, vec: str, centre_id, n: int) -> DataFrame:
    return similarity_to(vectors, key, vec, centre_id).orderBy(F.desc("score"), key).limit(n)


def spread_cutoff(scored: DataFrame, score: str = "score", share: float = 0.35, least_spread: float = 0.03) -> DataFrame:
    """Rows at or above top - share * spread; all, if the spread over the whole table is at most ``least_spread``."""
    ends = scored.agg(F.max(score).alias("__top"), F.min(score).alias("__low"))
    spread = F.col("__top") - F.col("__low")
    return scored.crossJoin(F.broadcast(ends)).where((spread <= least_spread) | (F.col(score) >= F.col("__top") - share * spread)).drop("__top", "__low")


def hybrid_merge(by_vector: DataFrame, by_text: DataFrame, key: str, encounter: Column | str) -> DataFrame:
    """(key, score, rank): text hits that the vector search lacks come first, in reverse order of encounter, at top + 0.01 (1 if there is no vector hit); then vector hits by score."""
    top = by_vector.agg(F.max("score").alias("__top"))
    only = by_text.join(by_vector.select(key), key, "left_anti").crossJoin(F.broadcast(top))
    boosted = only.select(key, F.coalesce(F.col("__top") + 0.01, F.lit(1.0)).alias("score"), F.lit(0).alias("__g"), (-F.col(encounter) if isinstance(encounter, str) else -encounter).cast("double").alias("__o"))
    rest = by_vector.select(key, "score", F.lit(1).alias("__g"), (-F.col("score")).alias("__o"))
    return global_rank(boosted.unionByName(rest), ["__g", "__o", key]).drop("__g", "__o")


def related_score(sim: Column, shared: Column, km: Column) -> Column:
    """0.70 similarity + 0.15 shared person + 0.15 nearness; a null distance adds nothing."""
    return 0.70 * sim + 0.15 * F.when(shared, 1.0).otherwise(0.0) + F.coalesce(0.15 / (1.0 + km / 2.0), F.lit(0.0))


def text_or(fields: list[str], query: str) -> Column:
    from tessera.functions.text import any_field_contains

    return any_field_contains(fields, query)


def related(rows: DataFrame, key: str, candidates: int, slots: int, geo_slots: int, most_km: float) -> DataFrame:
    """(key, score, route) from (key, sim, shared, km), km null without a position.

    The ``candidates`` most similar rows compete by their related score for what the nearest rows that are none of them leave of
    the ``slots``; a candidate whose place adds more than its likeness and person together is a ``geo`` match too. The others take up to ``geo_slots``, within ``most_km``, with a score without similarity. All are top-n limits.
    """
    top = rows.orderBy(F.desc("sim"), key).limit(candidates)
    place = F.coalesce(0.15 / (1.0 + F.col("km") / 2.0), F.lit(0.0))
    mostly_place = place > 0.70 * F.col("sim") + 0.15 * F.when(F.col("shared"), 1.0).otherwise(0.0)
    by_vector = top.select(key, related_score(F.col("sim"), F.col("shared"), F.col("km")).alias("score"), F.when(mostly_place, "geo").otherwise("vector").alias("route"))
    near = rows.where(F.col("km") <= most_km).join(F.broadcast(top.select(key)), key, "left_anti").orderBy("km", key).limit(geo_slots)
    by_geo = near.select(key, (0.15 / (1.0 + F.col("km") / 2.0) + 0.15 * F.when(F.col("shared"), 1.0).otherwise(0.0)).alias("score"), F.lit("geo").alias("route"))
    taken = F.broadcast(by_geo.agg(F.count("*").alias("__taken")))
    placed = by_vector.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # at most ``candidates`` rows
    kept = placed.crossJoin(taken).where(F.col("__r") <= slots - F.col("__taken")).select(key, "score", "route")
    return kept.unionByName(by_geo)


def grid_filter(rows: DataFrame, key: str, ids: DataFrame | None = None, bbox: tuple | None = None, folder: tuple[str, str] | None = None, text: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that meet all clauses that are set: an id set, a box of (south, west, north, east), a folder prefix, a text in some field."""
    from tessera.functions import geo

    if bbox is not None:
        rows = rows.where(geo.in_bbox(F.col("lat"), F.col("lon"), *bbox))
    if folder is not None:
        rows = rows.where(F.col(folder[0]).startswith(folder[1]))
    if text is not None:
        rows = rows.where(text_or(*text))
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")
