"""Hand-made values of functions, order-dependent operators against plain restatements, sources."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color, geo, optics, text
from tessera.operators import clustering, fitting, mutations, predicates, ranking, timeline
from tessera.sources import readers
from tessera.streaming import incremental


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_geo_values(spark):
    got = one(spark, geo.haversine_km(*map(F.lit, (35.6812, 139.7671, 34.7025, 135.4959))), geo.mercator_x(F.lit(139.7671), F.lit(10)), geo.mercator_y(F.lit(35.6812), F.lit(10)), geo.mercator_x(F.lit(0.0), F.lit(0)))
    assert got == pytest.approx([403.058320, 232847.2963, 103226.5743, 128.0], abs=1e-3)
    boxes = [F.lit(v) for v in (0.1, 0.1, 0.2, 0.2, 0.15, 0.15, 0.2, 0.2)]
    assert one(spark, geo.overlap(*boxes), geo.iou(*boxes)) == pytest.approx([0.5625, 0.391304], abs=1e-6)


def test_text_values(spark):
    got = one(
        spark, text.xmp_coordinate(F.lit("35,41.25894N")), text.xmp_coordinate(F.lit("35,41.25894S")), text.exif_seconds(F.lit("2024:05:03 18:43:45")), text.iso_to_exif(F.lit("2024-05-03T18:43:45")),
        text.rational(F.lit("59000/10000")), text.key_value(F.lit("CurveRefineSaturation = 9\nSaturation = +15"), "Saturation"), text.key_value(F.lit("SaturationAdj = 3\nSaturation = 7"), "Saturation"),
        text.before_space(F.lit("1/125 s")), text.tags_text(F.lit('["travel","sunrise"]')), text.join_path(F.lit("/Volumes/A/"), F.lit("2024/05/"), F.lit("x.ARW")),
    )
    assert got[:2] == pytest.approx([35.687649, -35.687649], abs=1e-6)
    assert got[2:] == [1714761825, "2024:05:03 18:43:45", 5.9, 15.0, None, "1/125", "travel, sunrise", "/Volumes/A/2024/05/x.ARW"]


def test_color_values(spark):
    for k, x, y in ((2000, 0.526903, 0.413265), (3000, 0.436579, 0.404174), (4000, 0.382344, 0.383766), (6500, 0.312779, 0.329183), (10000, 0.278800, 0.291967)):
        assert one(spark, color.kelvin_x(F.lit(k)), color.kelvin_y(F.lit(k))) == pytest.approx([x, y], abs=1e-6)
    got = color.with_wb(spark.createDataFrame([(3200, 5500), (7500, 5500), (5500, 0)], "t int, s int"), F.col("t"), F.col("s")).orderBy("t").select("r", "g", "b").collect()
    assert list(got[0]) == pytest.approx([1.77353, 1, 0.46528], abs=1e-3) and list(got[1]) == [1, 1, 1]
    tinted = color.with_wb(spark.createDataFrame([(7500, 5500)], "t int, s int"), F.col("t"), F.col("s"), target_tint=F.lit(10.0)).select("r", "g", "b").first()
    assert list(tinted) == pytest.approx([0.76061, 1, 1.32799], abs=1e-3)
    ratios = [(0.3, 2000), (0.5, 2458.861), (1.0, 5491.379), (1.2, 8019.048), (2.0, 12000)]
    assert one(spark, *[color.kelvin_from_ratio(F.lit(r), F.lit(1.0)) for r, _ in ratios]) == pytest.approx([k for _, k in ratios], abs=1e-2)
    w, h = color.rotated_size(F.lit(600.0), F.lit(400.0), F.lit(0.1))
    assert one(spark, w, h, color.vignetting_gain(F.lit(4096)), color.distortion_factor(F.lit(-164))) == pytest.approx([636.9359, 457.9017, 0.866273, 0.989990], abs=1e-4)


def test_asof_bounds(spark):
    track = spark.createDataFrame([(1, 1000.0, 35.0, 139.0), (1, 4600.0, 36.0, 140.0), (2, 1000.0, 1.0, 1.0), (2, 1000.0 + 86400, 2.0, 2.0)], "k int, t double, lat double, lon double")
    wanted = spark.createDataFrame([(1, 1, 1600.0), (1, 2, 4600.0 + 3600), (1, 3, 4600.0 + 3599), (1, 4, 0.0), (2, 5, 2000.0)], "k int, id int, t double")
    got = {r.id: (r.m_lat, r.m_lon) for r in timeline.asof_interpolate(wanted, track, ["k"], "id", "t", "lat", "lon").collect()}
    assert got == {1: (pytest.approx(35.166667, abs=1e-6), pytest.approx(139.166667, abs=1e-6)), 3: (36.0, 140.0)}


def test_gap_fill_goes_on_along_the_line(spark):
    rows = spark.createDataFrame([(1, 0.0, 34.9, 1.0), (1, 1800.0, 35.0, 1.0), (1, 2700.0, 0.0, 0.0), (1, 1800.0 + 1801, 0.0, 0.0)], "k int, t double, lat double, lon double")
    got = timeline.gap_fill(rows, ["k"], "t", "lat", "lon", geo.has_gps(F.col("lat"), F.col("lon"))).collect()
    assert [(r.t, r.how) for r in got] == [(2700.0, "after")] and got[0].lat == pytest.approx(35.05)


def test_series_in_buckets_equal_whole_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), i, float(t), float(la), float(la * 2)) for i, (k, t, la) in enumerate(zip(rng.integers(0, 3, 300), rng.permutation(9000)[:300] + 1, rng.choice([0.0, 0.0, 1.5, 2.5, 3.5], 300), strict=True))]
    df = spark.createDataFrame(rows, "k int, id int, t double, lat double, lon double")
    known = geo.has_gps(F.col("lat"), F.col("lon"))
    fill = lambda bucket: sorted((r.id, r.lat, r.how) for r in timeline.gap_fill(df.withColumn("x", F.lit(1)), ["k"], "t", "lat", "lon", known, 300, 400, bucket=bucket).collect())
    match = lambda bucket: sorted((r.id, r.m_lat) for r in timeline.asof_interpolate(df.where(~known).select("k", "id", "t"), df.where(known), ["k"], "id", "t", "lat", "lon", 100, 200, bucket=bucket).collect())
    for run in (fill, match):
        want = run(1e9)
        assert len(want) > 50
        for bucket in (10.0, 77.0, 1000.0):
            assert run(bucket) == want


def filled(rows, both, one):
    """Each blank row held against all known rows of its key."""
    out = []
    for k, i, t, lat in rows:
        if lat:
            continue
        known = sorted((u, v) for q, _, u, v in rows if q == k and v)
        before, after = [x for x in known if x[0] <= t][::-1], [x for x in known if x[0] >= t]
        if before and after and t - before[0][0] <= both and after[0][0] - t <= both:
            (pt, pv), (nt, nv) = before[0], after[0]
            out.append((i, "between", (pv + nv) / 2 if nt == pt else pv + (t - pt) / (nt - pt) * (nv - pv)))
            continue
        for near, how in ((before, "after"), (after, "before")):
            if near and abs(t - near[0][0]) <= one:
                (u, v), far = near[0], near[1:2]
                out.append((i, how, v + (v - far[0][1]) / (u - far[0][0]) * (t - u) if far else v))
                break
    return sorted(out)


@pytest.mark.parametrize("bucket", [7.0, 40.0, 1e6])
def test_gap_fill_against_all_known_rows(spark, bucket):
    """Keys of which one is null, one has a single known row and one none; blank rows at the time of a known one; the second neighbour in other buckets."""
    rng = np.random.default_rng(4)
    rows = []
    for key, n, share in ((None, 60, 0.3), (1, 90, 0.15), (2, 40, 0.0), (3, 30, 0.0)):
        times = rng.permutation(400)[:n] + 1
        rows += [(key, len(rows) + j, float(t), float(np.round(rng.uniform(1, 9), 2)) if rng.random() < share or (key == 2 and j == 0) else 0.0) for j, t in enumerate(times)]
    rows += [(k, 1000 + i, t, 0.0) for k, i, t, v in rows if v]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "k int, id int, t double, lat double, lon double")
    got = timeline.gap_fill(df, ["k"], "t", "lat", "lon", geo.has_gps(F.col("lat"), F.col("lon")), 12, 30, bucket=bucket).collect()
    want = filled(rows, 12, 30)
    assert {h for _, h, _ in want} == {"between", "after", "before"}
    assert sorted((r.id, r.how) for r in got) == [w[:2] for w in want]
    assert [r.lat for r in sorted(got, key=lambda r: r.id)] == pytest.approx([w[2] for w in want])
    assert timeline.gap_fill(df.limit(0), ["k"], "t", "lat", "lon", F.col("lat") != 0).collect() == []


def test_a_series_is_shuffled_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 3 as k", "cast(id as double) as t", "cast(id % 4 as double) as lat", "cast(id % 4 as double) as lon").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for df, most in ((timeline.gap_fill(rows, ["k"], "t", "lat", "lon", F.col("lat") != 0), 3), (timeline.asof_within(rows, ["k"], "id", "t", "lat", "lon", F.col("lat") != 0, F.col("lat") == 0), 3)):
        plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        assert plan[1].count("Exchange hashpartitioning") <= most and plan[0].count("FileScan") == 2


def greedy(v, threshold, whole=1000, window=600):
    """Seed by seed, as the survey states it: the window's end is the seed's place plus the window, itself included."""
    n = len(v)
    reach = n if n <= whole else window
    free, found = [True] * n, []
    for i in range(n):
        if not free[i]:
            continue
        members, centre = [i], v[i]
        for j in range(i + 1, min(i + reach, n)):
            if free[j] and centre @ v[j] > threshold:
                free[j] = False
                members.append(j)
                centre = centre * (len(members) - 1) / len(members) + v[j] / len(members)
                centre = centre / np.linalg.norm(centre)
        if len(members) > 1:
            found.append(members)
    return found


@pytest.mark.parametrize(("n", "whole", "window", "span"), [(300, 1000, 600, 4000), (700, 100, 15, 4000), (700, 100, 15, 60), (700, 100, 90, 50), (1300, 1000, 600, 400)])
def test_greedy_clusters_of_all_rows(spark, monkeypatch, n, whole, window, span):
    monkeypatch.setattr(clustering, "SPAN", span)
    rng = np.random.default_rng(n + window)
    v = rng.normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>").repartition(3)
    order = [r.k for r in rows.withColumn("p", clustering.vector.projection("v")).orderBy("p", "k").collect()]
    want = {order[i]: -1 - c for c, members in enumerate(greedy(v[order], 0.8, whole, window)) for i in members}
    got = {r.k: r.cluster for r in clustering.greedy_centroid(rows, "k", "v", 0.8, whole=whole, window=window).collect()}
    assert got == want and len(want) > 50


def test_greedy_clusters_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "k long, v array<double>")
    assert {r.k: r.cluster for r in clustering.greedy_centroid(rows, "k", "v", 0.6).collect()} == {1: -1, 4: -1}
    assert clustering.greedy_centroid(rows.limit(0), "k", "v", 0.6).count() == 0


def test_rounds_of_clusters_run_only_what_began_wrongly(spark, monkeypatch):
    """Windows longer than ranges, so that states run on: no more rounds than ranges, none of a final range."""
    folders = []
    monkeypatch.setattr(clustering, "SPAN", 50)
    monkeypatch.setattr(clustering, "new_folder", lambda spark, tag, made=clustering.new_folder: folders.append((tag, made(spark, tag))) or folders[-1][1])
    rng = np.random.default_rng(11)
    turn = np.sort(rng.uniform(0, 3, 600))
    v = np.stack([np.cos(turn), np.sin(turn)], 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    order = [r.k for r in rows.withColumn("p", clustering.vector.projection("v")).orderBy("p", "k").collect()]
    want = {order[i]: -1 - c for c, members in enumerate(greedy(v[order], 0.95, 10, 120)) for i in members}
    assert {r.k: r.cluster for r in clustering.greedy_centroid(rows, "k", "v", 0.95, whole=10, window=120).collect()} == want
    ran = spark.read.parquet(dict(folders)["clustered"]).select("round", "turn").distinct().collect()
    rounds = {r["round"] for r in ran}
    assert 2 <= len(rounds) <= len({r["turn"] for r in ran}) and all(r["turn"] >= r["round"] for r in ran)


def test_people_of_odd_faces(spark):
    schema = "id long, photo string, person int, v array<double>"
    faces = spark.createDataFrame([
        (1, "a", 7, [1.0, 0.0]), (2, "a", 7, None), (3, None, 7, [1.0, 0.1]), (4, "b", 8, []), (5, "b", None, [0.0, 1.0]), (6, "c", 0, [0.0, 1.0]),
        (7, "c", -1, [1.0, 0.0]), (8, "d", None, [1.0, 0.0]), (9, "d", None, None), (10, "e", 9, [0.0, 2.0]),
    ], schema).withColumn("name", F.lit("x")).withColumn("cluster", F.lit(1))
    names = spark.createDataFrame([(7, "Ann"), (9, None)], "person int, name string")
    groups, members, progress = clustering.people(faces, names, "id", "photo", "person", "v")
    got = [tuple(r) for r in groups.orderBy("rank").select("cluster", "name", "faces", "photos", "rep", "suggested").collect()]
    assert got == [(7, "Ann", 3, 1, 1, None), (8, "", 1, 1, 4, None), (9, "", 1, 1, 10, None), (-1, "", 2, 2, 5, None), (-2, "", 2, 2, 7, "Ann")]
    assert sorted(tuple(r) for r in members.collect()) == [(1, 7), (2, 7), (3, 7), (4, 8), (5, -1), (6, -1), (7, -2), (8, -2), (10, 9)]
    assert tuple(progress.first()) == (5, 5)
    assert tuple(clustering.people(faces, names, "id", "photo", "person", "v", page=2)[2].first()) == (2, 5)
    assert [df.count() for df in clustering.people(faces.limit(0), names.limit(0), "id", "photo", "person", "v")] == [0, 0, 1]


def test_best_centroid_in_blocks(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x)
    c, v = [unit(rng.normal(size=4)) for _ in range(23)], [unit(rng.normal(size=4)) for _ in range(40)]
    found = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "g long, centroid array<double>")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    want = {i: int(np.argmax([x @ y for y in c])) for i, x in enumerate(v) if max(x @ y for y in c) > 0.5}
    for block in (4, 100):
        assert {r.k: r.g for r in clustering.best_centroid(rows, "v", found, "g", 0.5, block=block).collect()} == want


def test_nms_keeps_the_best_of_overlapping(spark):
    rows = [("a", 1, 0.9, 0.0, 0.0, 1.0, 1.0), ("a", 2, 0.8, 0.1, 0.0, 1.0, 1.0), ("a", 3, 0.7, 2.0, 0.0, 1.0, 1.0), ("b", 4, 0.1, 0.1, 0.0, 1.0, 1.0)]
    got = ranking.greedy_nms(spark.createDataFrame(rows, "g string, id int, score double, x double, y double, w double, h double"), "g")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_nms_of_awkward_rows_needs_no_python_for_a_group(spark):
    nan = float("nan")
    rows = [("a", 1, nan, 0.0, 0.0, 1.0, 1.0), ("a", 2, None, 0.0, 0.0, 1.0, 1.0), ("a", 3, 0.5, 0.0, 0.0, 1.0, 1.0), ("a", 4, 0.9, None, 0.0, 1.0, 1.0), ("a", 5, 0.9, nan, 0.0, 1.0, 1.0)]
    rows += [(None, 6, 0.1, 0.0, 0.0, 1.0, 1.0), (None, 7, 0.1, 0.0, 0.0, 1.0, 1.0), ("b", 8, 0.3, 0.0, 0.0, 0.0, 1.0), ("b", 9, 0.3, 0.0, 0.0, 0.0, 1.0), ("c", 10, nan, 0.0, 0.0, 1.0, 1.0), ("c", 11, None, 0.0, 0.0, 1.0, 1.0)]
    found = ranking.greedy_nms(spark.createDataFrame(rows, "g string, id int, score double, x double, y double, w double, h double"), "g")
    assert sorted(r.id for r in found.collect()) == [3, 4, 5, 6, 8, 9, 10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_best_overlap_among_all_boxes_of_an_image(spark):
    rng = np.random.default_rng(8)
    side = lambda: [float(v) for v in rng.integers(1, 4, 4) / 4]
    a, b = [(i, ["p", "q", None][i % 3], *side()) for i in range(90)], [(i * 100, ["p", "q", None][i % 3], *side()) for i in range(90)]
    a += [(0, "q", *side()), (7000, "p", None, 0.1, 0.1, 0.1), (7001, "p", 0.1, 0.1, 0.0, 0.0), (7002, "none", *side())]
    kind = "{0} long, i string, {1}x double, {1}y double, {1}w double, {1}h double"
    got = ranking.best_overlap(spark.createDataFrame(a, kind.format("k", "a")), spark.createDataFrame(b, kind.format("o", "c")), ["i"], "k", "o", ("ax", "ay", "aw", "ah", "cx", "cy", "cw", "ch"), 0.5)
    want = {}
    for k, i, x, y, w, h in a:
        for o, j, *c in b:
            if i is None or i != j or x is None or not w * h:
                continue
            both = max(0, min(x + w, c[0] + c[2]) - max(x, c[0])) * max(0, min(y + h, c[1] + c[3]) - max(y, c[1]))
            part = both / min(w * h, c[2] * c[3])
            if part > 0.5:
                want[k] = max(want.get(k, (0, 0)), (round(part, 6), -o))
    assert {r["k"]: (r["overlap"], -r["o"]) for r in got.collect()} == want and len(want) > 30 and got.count() == len(want)


def test_sigma_clipping_ignores_outliers(spark):
    rows = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.lit(1.0).alias("one"))
    rows = rows.withColumn("y", 3 * F.col("x") + 2 + F.when(F.col("x") == 7, 500.0).otherwise(0.0))
    got = {r.term: r for r in fitting.sigma_clipped(rows, "y", ["one", "x"]).collect()}
    assert got["x"].weight == pytest.approx(3, abs=1e-6) and got["one"].weight == pytest.approx(2, abs=1e-6) and got["x"].share == pytest.approx(0.98)


def test_stacks_have_one_primary_and_mutations_settle(spark):
    files = spark.createDataFrame([(1, "d", "a", 0, 5), (2, "d", "a", 2, 1), (3, "d", "b", 1, 1), (4, "d", "b", 1, 2), (5, "e", "a", 0, 1)], "id int, dir string, stem string, category int, size int")
    got = {r.id: (r.stack_id, r.stack_primary) for r in mutations.resolve_stacks(files, "id", ["dir", "stem"], "category", "size").collect()}
    assert got == {1: (2, False), 2: (2, True)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = mutations.upsert(old, new, ["k"])
    assert sorted(map(tuple, mutations.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, mutations.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_global_rank_of_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(13)
    got = ranking.global_rank(rows, ["v"]).orderBy("v").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))


def test_streams_equal_batches_over_several_files(spark, tmp_path):
    path = f"{tmp_path}/events"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(12).cache()
    events.write.parquet(path)
    want = {(r.user_id, r.n) for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {(r.user_id, r.n) for r in incremental.latest_per_user(spark, path).collect()} == want
    assert incremental.first_seen(spark, path, ["user_id", "event_type"]).count() == events.select("user_id", "event_type").distinct().count()


def test_first_seen_forgets_what_time_has_passed(spark, tmp_path):
    """Repeats within the day, and in the batch that lets a key go, are told; one after that batch is new. Without a time it is told too."""
    path, day = f"{tmp_path}/rows", 86_400
    for rows in ([("a", 0)], [("a", 600), ("b", 3 * day)], [("a", 3 * day + 60), ("b", 3 * day + 90), (None, 3 * day)], [("a", 3 * day + 120)]):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    seen = lambda *args: sorted((r.k or "-") for r in incremental.first_seen(spark, path, ["k"], *args, files_a_batch=1).collect())
    assert seen("ts", "1 day") == ["-", "a", "a", "b"] and seen() == ["-", "a", "b"]


def test_sources(spark, tmp_path):
    (tmp_path / "m/x").mkdir(parents=True)
    for name in ("m/a.JPG", "m/x/b.arw", "m/x/c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    found = readers.scan_files(spark, f"{tmp_path}/m")
    assert sorted((r.id, r["class"]) for r in found.collect()) == [("a.JPG_5", "image"), ("b.arw_5", "raw")]
    known = spark.createDataFrame([("a.JPG_5",)], "id string")
    assert [r.id for r in readers.new_files(found, known).collect()] == ["b.arw_5"]
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="35" lon="139"><time>2024-12-15T10:30:45Z</time></trkpt><trkpt lat="36" lon="140"><time>2024-12-15T10:30:45+09:00</time></trkpt></trkseg></trk></gpx>')
    track = readers.read_gpx(spark, f"{tmp_path}/t.gpx").collect()
    assert len({r.time for r in track}) == 1 and sorted(r.lat for r in track) == [35.0, 36.0]
    (tmp_path / "s.xmp").write_text('<rdf:Description xmp:Rating="4" xmp:Label="Red" exif:GPSLatitude="35,41.25894N" exif:GPSLongitude="139,50.14254E"/>')
    side = readers.read_xmp(spark, f"{tmp_path}/s.xmp").first()
    assert (side.rating, side.label) == (4, "Red") and side.longitude == pytest.approx(139.835709)
    (tmp_path / "lib.json").write_text(json.dumps({"photos": [{"id": "a", "rating": 3}, {"id": "b"}]}))
    schema = spark.createDataFrame([], "id string, rating int").schema
    rows = readers.read_library_json(spark, f"{tmp_path}/lib.json", schema, {"rating": 0})
    assert sorted(map(tuple, rows.collect())) == [("a", 3), ("b", 0)]
    blob = spark.createDataFrame([(bytearray(np.array([1.5, -2], dtype="<f4").tobytes()), bytearray(np.array([2.5], dtype=">f8").tobytes()))], "v binary, w binary")
    row = readers.unpack_big_endian(readers.unpack_vectors(blob, "v", "x"), "w", "y").first()
    assert (row.x, row.y) == ([1.5, -2.0], [2.5])


def test_auto_scale_is_the_least_that_fits(spark):
    knots = [i / 10 for i in range(11)]
    rows = [(1, 600, 400, 600, 400, 299.5, 199.5, knots, [1 + k / 10 for k in knots], None, None), (2, 600, 400, 600, 400, 299.5, 199.5, knots, [1 - k / 10 for k in knots], None, None), (3, 600, 400, 600, 400, 299.5, 199.5, knots, [1.0] * 11, [1 + k / 20 for k in knots], [1.0] * 11)]
    df = spark.createDataFrame(rows, "id int, src_w int, src_h int, out_w int, out_h int, crop_cx double, crop_cy double, knots array<double>, distortion array<double>, red array<double>, blue array<double>")
    got = {r.id: r.scale for r in optics.auto_scale(df).collect()}
    # at the corner the radius is 1 / s, and the point moves out by 1 + r / 10: it stays inside from s = 1 + 1 / (10 s) on
    assert got[2] == 1.0 and got[1] == pytest.approx((1 + 1.4**0.5) / 2, abs=1e-5) and got[3] == pytest.approx((1 + 1.2**0.5) / 2, abs=1e-5)


def test_auto_scale_of_mixed_rows(spark):
    """Rows of one to nine knots, with and without colours, against a bisection of each by itself."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(60):
        n = int(rng.integers(1, 10))
        knots = np.sort(rng.choice(np.arange(12), n, replace=False)) / 10.0
        lines = [1 + rng.uniform(-0.05, 0.15, n), *(1 + rng.uniform(-0.02, 0.05, (2, n)))]
        red, blue = (lines[1], lines[2]) if i % 3 else (None, lines[2] if i % 2 else None)
        cx, cy = 299.5 + float(rng.uniform(-9, 9)), 199.5
        rows.append((i, 600, 400, 560, 380, cx, cy, knots.tolist(), lines[0].tolist(), *(None if c is None else c.tolist() for c in (red, blue))))

        def fits(scale, cx=cx, cy=cy, knots=knots, main=lines[0], red=red, blue=blue):
            for u, v in optics.PROBES:
                x, y = cx + (u - 0.5) * 559 / scale - 299.5, cy + (v - 0.5) * 379 / scale - 199.5
                f = np.interp(np.hypot(x, y) / np.hypot(299.5, 199.5), knots, main)
                r = np.hypot(x, y) / np.hypot(299.5, 199.5)
                for c in (f, *(() if red is None or blue is None else (f * np.interp(r, knots, red), f * np.interp(r, knots, blue)))):
                    if abs(x * c + 299.5 - cx) > 279.5 + 1e-9 or abs(y * c + 199.5 - cy) > 189.5 + 1e-9:
                        return False
            return True

        low, high = 1.0, 1.5
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        want[i] = 1.0 if fits(1.0) else high
    df = spark.createDataFrame(rows, "id int, src_w int, src_h int, out_w int, out_h int, crop_cx double, crop_cy double, knots array<double>, distortion array<double>, red array<double>, blue array<double>")
    got = {r.id: r.scale for r in optics.auto_scale(df).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(set(want.values())) > 30


def test_crop_quads_with_perspective_lead_back(spark):
    names = {"width": "width", "height": "height", "angle": "angle", "shear": "shear", "tilt_v": "tv", "tilt_h": "th", "focal": "focal"}
    rows = [(600, 400, 0.2, 0.05, 6.0, -4.0, 35, 0.2, 0.3, 0.4, 0.5), (600, 400, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "width int, height int, angle double, shear double, tv double, th double, focal int, x double, y double, w double, h double")
    got = optics.with_warped_size(df, **names).withColumn("quad", optics.crop_quad(("x", "y", "w", "h"), **names)).orderBy("angle").collect()
    assert [(p.u, p.v) for p in got[0].quad] == [pytest.approx(c, abs=1e-9) for c in ((0, 0), (1, 0), (1, 1), (0, 1))]
    r = got[1]
    for p, (bx, by) in zip(r.quad, ((r.x, r.y), (r.x + r.w, r.y), (r.x + r.w, r.y + r.h), (r.x, r.y + r.h)), strict=True):
        u, v = one(spark, *optics.forward_warp(*(F.lit(a) for a in (p.u, p.v, r.shear, r.tv, r.th, r.focal))))
        x, y = (u - 0.5) * r.width, (v - 0.5) * r.height
        turned = (x * np.cos(r.angle) - y * np.sin(r.angle), x * np.sin(r.angle) + y * np.cos(r.angle))
        assert (turned[0] / r.box_w + 0.5, turned[1] / r.box_h + 0.5) == (pytest.approx(bx), pytest.approx(by))


def test_similarity_of_the_template_is_the_identity(spark):
    xs, ys = (F.array(*(F.lit(p[i]) for p in optics.FACE_TEMPLATE)) for i in (0, 1))
    m = spark.range(1).select(optics.similarity(xs, ys).alias("m")).first().m
    assert list(m) == pytest.approx([1, 0, 0, 0], abs=1e-9)


def test_ratio_lut_against_plain_least_squares(spark):
    rng = np.random.default_rng(4)
    src, tgt = rng.uniform(0.05, 1, (24, 3)), rng.uniform(0.05, 1, (24, 3))
    lum = np.array(fitting.LUMA)
    expand = lambda m: np.column_stack([np.prod(m[:, ["rgb".index(c) for c in t]], axis=1) for t in fitting.rgb_terms(2)])
    ratio = np.clip((tgt / (tgt @ lum)[:, None]) / (src / (src @ lum)[:, None]), 0.5, 2)
    w = np.linalg.lstsq(expand(np.vstack([src, fitting.ANCHORS])), np.vstack([ratio, np.ones((7, 3))]), rcond=None)[0]
    axis = np.arange(5) / 4
    grid = np.array([(r, g, b) for r in axis for g in axis for b in axis])
    level = (grid @ lum)[:, None]
    shown = grid / np.maximum(level, 1e-6) * np.clip(expand(grid) @ w, 0.5, 2)
    want = np.clip(np.where(level < 1e-6, 0, shown * level / np.maximum((shown @ lum)[:, None], 1e-9)), 0, 1)
    got = fitting.ratio_lut(spark.createDataFrame(np.hstack([src, tgt]).tolist(), "r double, g double, b double, tr double, tg double, tb double"), size=5).orderBy("ri", "gi", "bi").select("vr", "vg", "vb").collect()
    assert np.allclose(np.array(got), want, atol=1e-6)


def test_sidecars_are_read_and_merged(spark, tmp_path):
    old = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmp:Rating="9" crs:Exposure2012="+0.5" exif:GPSAltitude="59000/10000" exif:GPSAltitudeRef="1"><xmp:Label>Red</xmp:Label><dc:description><rdf:Alt><rdf:li xml:lang="x-default">a &lt;b&gt; &amp;amp; c</rdf:li></rdf:Alt></dc:description><dc:subject><rdf:Bag><rdf:li>sea</rdf:li><rdf:li>sun "x"</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>'
    (tmp_path / "a.xmp").write_text(old)
    got = readers.read_xmp(spark, f"{tmp_path}/a.xmp").first()
    assert (got.rating, got.label, got.memo, json.loads(got.tags), got.altitude) == (5, "Red", "a <b> &amp; c", ["sea", 'sun "x"'], -5.9)
    rows = [(f"{tmp_path}/a.jpg", 3, "", "new & <memo>", '["hill"]', True), (f"{tmp_path}/b.jpg", 2, "Blue", "", "not json", True), (f"{tmp_path}/c.jpg", 1, "", "", "", False), ("", 1, "", "", "", True)]
    photos = spark.createDataFrame(rows, "path string, rating int, label string, memo string, tags string, managed boolean")
    readers.write_texts(readers.with_sidecars(photos, spark.createDataFrame([(f"{tmp_path}/a.xmp", old)], "path string, xml string")))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.xmp", "b.xmp"]
    new = {r.path[-5:]: r for r in readers.read_xmp(spark, str(tmp_path)).collect()}
    assert tuple(new["a.xmp"])[1:5] == (3, "", "new & <memo>", '["hill"]') and tuple(new["b.xmp"])[1:5] == (2, "Blue", "", "")
    assert 'crs:Exposure2012="+0.5"' in (tmp_path / "a.xmp").read_text() and new["a.xmp"].altitude == -5.9


def test_cubes_are_written_and_read(spark, tmp_path):
    nodes = fitting.lut_grid(spark, 3).select("ri", "gi", "bi", F.col("r").alias("vr"), (F.col("g") / 2).alias("vg"), (1 - F.col("b")).alias("vb"))
    readers.write_cube(nodes, f"{tmp_path}/cam/one", 3, "One")
    (part,) = (tmp_path / "cam/one").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[:5] == ['TITLE "One"', "LUT_3D_SIZE 3", "DOMAIN_MIN 0.0 0.0 0.0", "DOMAIN_MAX 1.0 1.0 1.0", ""] and lines[5:8] == ["0.000000 0.000000 1.000000", "0.500000 0.000000 1.000000", "1.000000 0.000000 1.000000"] and len(lines) == 32
    (tmp_path / "cam/std.cube").write_text(part.read_text())
    got = readers.read_cube(spark, f"{tmp_path}/cam")
    assert sorted(map(tuple, got.select("ri", "gi", "bi", "r", "g", "b").collect())) == sorted(map(tuple, nodes.collect()))
    assert [tuple(r)[:2] for r in readers.read_profiles(spark, str(tmp_path)).collect()] == [("cam", "std")]


def test_correction_steps_and_maker_notes(spark):
    be = lambda *v: b"".join(int(x).to_bytes(4, "big") for x in v)
    step = lambda kind, body: be(kind, 0x01030000, 0, len(body)) + body
    warp = be(1) + np.arange(8, dtype=">f8").tobytes()
    gain = be(0, 0, 10, 10, 0, 1, 2, 3, 2, 2) + np.zeros(4, dtype=">f8").tobytes() + be(1) + np.array([1, 1.5, 2, 2.5], dtype=">f4").tobytes()
    good = (be(3) + step(4, b"abc") + step(1, warp) + step(1, be(9)), be(1) + step(9, gain))
    rows = [(1, *map(bytearray, good)), (2, bytearray(b"xy"), bytearray(be(5) + step(9, gain[:40]))), (3, None, None)]
    got = {r.id: r for r in readers.unpack_opcodes(spark.createDataFrame(rows, "id int, w binary, g binary"), "w", "g").collect()}
    assert got[1].warp.coefficients == [[0, 1, 2, 3, 4, 5]] and (got[1].warp.cx, got[1].warp.cy) == (6, 7)
    assert (got[1].gain.rows, got[1].gain.cols, got[1].gain.row_pitch, list(got[1].gain.data)) == (2, 2, 2, [1, 1.5, 2, 2.5])
    assert [got[i][c] for i in (2, 3) for c in ("warp", "gain")] == [None] * 4
    le = lambda n, *v: b"".join(int(x).to_bytes(n, "little") for x in v)
    note = b"SIGMA\0" + b"\1\0\0\0" + le(2, 2) + le(2, 0x10, 2) + le(4, 6, 1000) + le(2, 0x3D, 2) + le(4, 9, 1006) + b"other\0" + b"Standard\0"
    short = b"SIGMA\0" + b"\1\0\0\0" + le(2, 1) + le(2, 0x3D, 2) + le(4, 3) + b"FC\0\0"
    notes = spark.createDataFrame([(i, None if n is None else bytearray(n)) for i, n in enumerate((note, short, b"NIKON" + note[5:], note[:30], None))], "id int, n binary")
    assert [r.mode for r in readers.with_maker_tag(notes, "n", "mode").orderBy("id").collect()] == ["Standard", "FC", "", "", ""]


def test_foreign_catalogue_as_csv(spark, tmp_path):
    (tmp_path / "images.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "tags.csv").write_text("id,tag\n1,x\n")
    found = readers.read_exported(spark, str(tmp_path))
    assert sorted(found) == ["images", "tags"] and found["images"].join(found["tags"], "id").select("name", "tag").collect() == [("a", "x")]


def test_predicates_of_photos(spark):
    plain = {"sync_state": 0, "local_path": "/a.arw", "present": True, "is_raw": False, "is_video": False, "lens_correction_params": "{}", "exposure_time": "1/60 s", "orientation": 1, "focal_length_35mm": 35, "width": 6, "height": 4, "preview_path": "sp", "preview_present": True, "face_scanned": False, "as_shot_temp": 0}
    cases = [
        ({}, "uf"), ({"local_path": ""}, "f"), ({"sync_state": 1, "present": False}, "f"), ({"width": 0}, "uxf"), ({"lens_correction_params": "", "exposure_time": "", "focal_length_35mm": 0}, "uxf"),
        ({"lens_correction_params": ""}, "uf"), ({"lens_correction_params": "", "is_raw": True}, "uxfw"), ({"is_raw": True, "as_shot_temp": 5500}, "uf"), ({"preview_present": False}, "up"), ({"preview_path": "", "is_video": True}, "u"), ({"face_scanned": True}, "u"),
    ]
    df = spark.createDataFrame([{"i": i, **plain, **change} for i, (change, _) in enumerate(cases)])
    flags = {"u": predicates.pending_upload(), "x": predicates.needs_exif(), "p": predicates.needs_preview(), "f": predicates.needs_faces(), "w": predicates.needs_white_balance()}
    got = df.orderBy("i").select(*[c.alias(name) for name, c in flags.items()]).collect()
    assert ["".join(n for n in flags if r[n]) for r in got] == [want for _, want in cases]
    states = one(spark, *[predicates.state_after_upload(F.lit(s), F.lit(ok).cast("boolean")) for s, ok in ((1, True), (1, False), (1, None), (3, True))], predicates.loaded_state(F.lit(1)))
    assert states == [2, 0, 1, 3, 0]
