"""Centroids and greedy clusters of unit vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.workspace import new_folder, written

from .ranking import global_rank

SPAN = 4_000  # vectors of one range of the greedy clusters, which one task holds; some windows long, so that ranges hardly lean on each other


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, centroid): the normalised sum; summed by position, so that map-side partial sums are all that moves."""
    parts = vectors.select(group, F.posexplode(vec).alias("__pos", "__v")).groupBy(group, "__pos").agg(F.sum(F.col("__v").cast("double")).alias("__s"), F.count("*").alias("__n"))
    summed = parts.groupBy(group).agg(F.max("__n").alias("n"), F.array_sort(F.collect_list(F.struct("__pos", "__s"))).alias("__p"))
    return summed.select(group, "n", vector.l2_normalize(F.transform("__p", lambda x: x["__s"])).alias("centroid"))


def best_centroid(vectors: DataFrame, vec: str, found: DataFrame, group: str, threshold: float, block: int = 10_000) -> DataFrame:
    """Each vector with its nearest centroid (group, score) if over the threshold; equal scores fall to the least group.

    The centroids, a given query set against all rows, go to every task in blocks of at most ``block``; the best of one block
    is carried to the next, so a vector is one row throughout.
    """
    count = found.count()
    blocks = max(1, -(-count // block))
    if blocks > 1:
        found = written(found.withColumn("__k", F.pmod(F.xxhash64(group), F.lit(blocks))), "centroids")
    matched = vectors.withColumn("__b", F.lit(None).cast(f"struct<s:double,g:{found.schema[group].dataType.simpleString()}>"))
    for k in range(blocks):
        own = found.where(F.col("__k") == k) if blocks > 1 else found
        listed = own.agg(F.collect_list(F.struct(F.col(group).alias("g"), "centroid")).alias("__all"))
        best = F.array_max(F.transform("__all", lambda c: F.struct(vector.dot(vec, c["centroid"]).alias("s"), (-c["g"]).alias("g"))))
        matched = matched.crossJoin(F.broadcast(listed)).withColumn("__b", F.greatest("__b", best)).drop("__all")
    matched = matched.where(F.col("__b.s") > threshold)
    return matched.withColumn(group, -F.col("__b.g")).withColumn("score", F.col("__b.s")).drop("__b")


STATE = "seeds array<long>, sizes array<long>, centres array<double>"


def cluster_range(vectors: np.ndarray, first: int, state: tuple, threshold: float, window: int) -> tuple[np.ndarray, tuple]:
    """The seed of each row of the places from ``first`` on, and the clusters that are still open behind them.

    A seed takes the free rows of the next ``window - 1`` places that are similar enough to its running centroid. Told row by
    row: each goes to the earliest open cluster that takes it, else it seeds one; a cluster is open for ``window - 1`` places.
    A state is (seeds, sizes, centres) in order of the seeds.
    """
    width = vectors.shape[1]
    seeds, sizes = list(state[0]), list(state[1])
    block = np.zeros((2 * window + 2, width))
    block[: len(seeds)] = np.reshape(np.asarray(state[2], dtype=float), (len(seeds), width))
    low, high = 0, len(seeds)  # the open clusters, in the same places of seeds, sizes and block
    seeds, sizes = seeds + [0] * (len(block) - high), sizes + [0] * (len(block) - high)
    out = np.empty(len(vectors), dtype=np.int64)
    for place, v in enumerate(vectors, first):
        while low < high and seeds[low] <= place - window:
            low += 1
        taken = block[low:high] @ v > threshold
        if taken.any():
            c = low + int(np.argmax(taken))
            sizes[c] += 1
            centre = block[c] * (sizes[c] - 1) / sizes[c] + v / sizes[c]
            size = np.sqrt(centre @ centre)
            block[c] = centre / size if size > 0 else centre
        else:
            if high == len(block):
                n = high - low
                block[:n], seeds[:n], sizes[:n] = block[low:high].copy(), seeds[low:high], sizes[low:high]
                low, high = 0, n
            c, high = high, high + 1
            block[c], seeds[c], sizes[c] = v, place, 1
        out[place - first] = seeds[c]
    return out, (seeds[low:high], sizes[low:high], block[low:high].copy())


def greedy_centroid(vectors: DataFrame, key: str, vec: str, threshold: float = 0.60, page: int | None = None, whole: int = 1000, window: int = 600) -> DataFrame:
    """(key, cluster): greedy clusters, from -1 downwards in order of creation, of all vectors or of the first ``page`` by key.

    Rows are taken in order of projection; up to ``whole`` are compared in full, of more those less than ``window`` places
    apart. The order is cut into ranges of about ``SPAN`` rows. All ranges are clustered at once, each from the clusters that it
    takes the range before to leave open; those that were taken wrongly are clustered again from what it did leave, until none is.
    What a range leaves hardly depends on what it was given, so two or three rounds do; the result is that of one pass in order.
    A round runs and writes only ranges that began wrongly. The first n ranges are final after n rounds, so there are at most as many
    rounds as ranges, and as many only where each range's end turns on its start.
    Rows of a cluster of one are left out; null and empty vectors are in none. Needs ``threshold`` >= 0.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(key).limit(page) if page is not None else vectors
    width = first.where(F.size(vec) > 0).select(F.size(vec).alias("n")).first()
    zeros = F.array_repeat(F.lit(0.0), width["n"] if width else 1)
    filled = first.select(key, F.when(F.size(vec) > 0, F.col(vec).cast("array<double>")).otherwise(zeros).alias("vec"), F.coalesce(vector.projection(vec), F.lit(0.0)).alias("projection"))
    n = filled.count()
    reach, span = (max(n, 1), max(n, 1)) if n <= whole else (window, SPAN)
    path, kind = new_folder(spark, "ranges"), vectors.schema[key].dataType.simpleString()
    # places are told from the written table: a second run of the sort need not cut it alike
    filled.repartitionByRange(max(1, -(-n // span)), "projection", key).withColumn("range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    places = written(rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), (F.row_number().over(Window.orderBy("range")) - 1).alias("turn")), "places")

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(given):
            return pd.DataFrame(columns=[key, "seed", "turn", "seeds", "sizes", "centres"])
        own = own.sort_values(["projection", key], kind="stable")
        start = given.iloc[0]
        seeds, (left, sizes, centres) = cluster_range(np.stack(own["vec"].to_numpy()), int(start["at"]), (start["seeds"], start["sizes"], start["centres"]), threshold, reach)
        out = pd.DataFrame({key: own[key].to_numpy(), "seed": seeds, "turn": int(start["turn"]), "seeds": None, "sizes": None, "centres": None})
        state = pd.DataFrame({key: [None], "seed": [-1], "turn": [int(start["turn"])], "seeds": [left], "sizes": [sizes], "centres": [centres.ravel()]})
        return pd.concat([out, state.astype({key: out[key].dtype}, errors="ignore")])

    nothing = [F.array().cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in STATE.split(", ")]
    names = ["seeds", "sizes", "centres"]
    todo = written(places.select("range", "at", "turn", *nothing), "given")
    last = written(todo.select("turn", F.xxhash64(*names).alias("given"), F.lit(0).alias("round")), "last")  # of each range, what its last run began with, and when that was
    path = new_folder(spark, "clustered")
    for turn in range(max(1, places.count())):  # the first n ranges are final after n rounds
        fresh = rows.join(F.broadcast(todo.select("range")), "range", "left_semi").groupBy("range").cogroup(todo.groupBy("range")).applyInPandas(run, f"`{key}` {kind}, seed long, turn int, {STATE}")
        fresh.write.parquet(f"{path}/round={turn}")
        left = spark.read.parquet(f"{path}/round={turn}").where("seed < 0").select((F.col("turn") + 1).alias("turn"), *names)
        wrong = left.join(last.select("turn", "given"), "turn").where(F.xxhash64(*names) != F.col("given")).drop("given")
        todo = written(places.join(wrong, "turn").select("range", "at", "turn", *names), "given")
        if todo.isEmpty():
            break
        again = todo.select("turn", F.xxhash64(*names).alias("now"))
        last = written(last.join(again, "turn", "left").select("turn", F.coalesce("now", "given").alias("given"), F.when(F.col("now").isNotNull(), turn + 1).otherwise(F.col("round")).alias("round")), "last")
    seeded = spark.read.parquet(path).where("seed >= 0").join(last.select("turn", "round"), ["turn", "round"], "left_semi").select(key, "seed")
    several = written(seeded.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "several")
    named = global_rank(several, ["seed"]).select("seed", (-F.col("rank")).cast("int").alias("cluster"))
    return seeded.join(named, "seed").select(key, "cluster")


def running_centres(placed: DataFrame, group: str, order: list[str], vec: str) -> DataFrame:
    """(group, centre): the centroid as it runs while members join in order, normalised at each step. For groups of a bounded size, such as a window's."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(vec).cast("array<double>").alias("__v"))))
    listed = placed.groupBy(group).agg(rows.alias("__rows"))
    start = F.struct(F.get("__rows", F.lit(0))["__v"].alias("c"), F.lit(1.0).alias("n"))

    def joined(state, row):
        n = state["n"] + 1.0
        mean = F.zip_with(state["c"], row["__v"], lambda c, v: c * (n - 1.0) / n + v / n)
        return F.struct(vector.l2_normalize(mean).alias("c"), n.alias("n"))

    later = F.slice("__rows", F.lit(2), F.greatest(F.size("__rows") - 1, F.lit(0)))
    return listed.select(group, F.aggregate(later, start, joined, lambda s: s["c"]).alias("centre"))


def people(faces: DataFrame, names: DataFrame, key: str, photo: str, person: str, vec: str, threshold: float = 0.60, page: int | None = None, whole: int = 1000, window: int = 600) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces (key, photo, person, vec) put together by person, those without one (null or <= 0) by greedy clusters.

    Gives (groups, members, progress). Groups: (cluster, name, faces, photos, rep, suggested, rank): a person's id or a cluster's negative number; the name of
    ``names`` (person, name) or ''; how many faces and distinct photos; its first face, by key or in order of projection; for a cluster the name of the
    person whose centroid is most like its running one, if over ``threshold``, else null: a person without a name suggests none, and none instead.
    Persons come first, those in most photos first, then clusters in order of creation. Members: (key, cluster). Progress: one row (processed, total) of
    the faces without a person, of which the first ``page`` by key are clustered. Of persons equally like, the least id suggests its name.
    Null photos are not counted; faces with null or empty vectors belong to their person but not to its centroid, and to no cluster. Empty tables give empty ones.
    """
    own = faces.select(F.col(key).alias("__key"), F.col(photo).alias("__photo"), F.coalesce(F.col(person).cast("long"), F.lit(0)).alias("__person"), F.col(vec).alias("__vec"))
    named, rest = own.where("__person > 0"), own.where("__person <= 0")
    found = greedy_centroid(rest.select("__key", "__vec"), "__key", "__vec", threshold, page, whole, window)
    members = written(named.select("__key", F.col("__person").alias("cluster")).unionByName(found.select("__key", F.col("cluster").cast("long").alias("cluster"))), "members")
    place = F.when(F.col("cluster") < 0, F.coalesce(vector.projection("__vec"), F.lit(0.0))).otherwise(0.0)
    placed = own.join(members, "__key").withColumn("__place", place)
    groups = placed.groupBy("cluster").agg(F.count("*").alias("faces"), F.countDistinct("__photo").alias("photos"), F.min(F.struct("__place", "__key"))["__key"].alias("rep"))

    called = names.select(F.col(names.columns[0]).cast("long").alias("cluster"), F.coalesce(F.col(names.columns[1]), F.lit("")).alias("name"))
    centres = running_centres(placed.where("cluster < 0"), "cluster", ["__place", "__key"], "__vec")
    like = best_centroid(centres, "centre", centroids(named, "__person", "__vec"), "__person", threshold).select("cluster", F.col("__person").alias("like"))
    told = like.join(called.select(F.col("cluster").alias("like"), F.col("name").alias("suggested")), "like").where("suggested <> ''").select("cluster", "suggested")
    full = written(groups.join(called, "cluster", "left").withColumn("name", F.coalesce("name", F.lit(""))).join(told, "cluster", "left"), "groups")
    known = F.col("cluster") > 0
    ranked = global_rank(full, [known.desc(), F.when(known, F.col("photos")).desc_nulls_last(), F.when(known, F.col("cluster")), F.col("cluster").desc()])
    total = rest.agg(F.count("*").alias("total"))
    progress = total.select((F.col("total") if page is None else F.least("total", F.lit(page))).cast("long").alias("processed"), "total")
    return ranked.select("cluster", "name", "faces", "photos", F.col("rep"), "suggested", "rank"), members.select(F.col("__key").alias(key), "cluster"), progress
