"""Tag directories from hand-built bytes, free names against a restatement, cubes and places on awkward rows."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cubes, optics
from tessera.operators import boxes, gazetteer, hierarchy, mutations
from tessera.plans import catalogue, media
from tessera.plans.media import tiff_file
from tessera.sources import tags

IMAGE = [(0x010F, 2, b"Maker\0"), (0x0110, 2, b"X-1\0"), (0x0112, 3, [6]), (0x0100, 4, [4000]), (0x0101, 4, [3000]), (0x8769, 4, [0]), (0x8825, 4, [0])]
GPS = [(1, 2, b"S\0"), (2, 5, [35, 1, 30, 1, 3600, 100]), (3, 2, b"E\0"), (4, 5, [139, 1, 45, 1, 0, 1]), (5, 1, [1]), (6, 5, [123, 10])]


def exif(note=b""):
    out = [(0x829A, 5, [10, 1250]), (0x829D, 5, [28, 10]), (0x8827, 3, [400]), (0x9003, 2, b"2024:01:02 03:04:05\0"), (0x9010, 2, b"+09:00\0"), (0x9204, 10, [-1, 3]), (0x9206, 5, [3, 2]), (0x920A, 5, [50, 1])]
    out += [(0x927C, 7, note)] if note else []
    out += [(0x9291, 2, b"12\0"), (0xA403, 3, [1]), (0xA405, 3, [75]), (0xA431, 2, b"B123\0"), (0xA433, 2, b"Lens Co\0"), (0xA434, 2, b"50mm F1.4\0"), (0xA435, 2, b"L9\0")]
    return [(t, {"s": k}.get(k, k), v) for t, k, v in out]


def made(order="<", note=b"", image=IMAGE):
    return tiff_file(order, image, exif(note), GPS)


@pytest.mark.parametrize("order", "<>")
def test_all_fields(order):
    got = tags.read_tags(made(order))
    want = {
        "camera_make": "Maker", "camera": "X-1", "lens": "50mm F1.4", "lens_make": "Lens Co", "focal_length": 50.0, "aperture": 2.8, "iso": 400.0, "date_time_original": "2024:01:02 03:04:05", "width": 4000,
        "height": 3000, "style": None, "longitude": 139.75, "altitude": -12.3, "exposure_time": "1/125", "orientation": 6, "white_balance": "Manual", "focal_length_35mm": 75, "offset_time": "+09:00",
        "body_serial": "B123", "lens_serial": "L9", "subject_distance": 1.5, "subsec_time": "12",
    }
    assert {k: v for k, v in got.items() if k not in ("latitude", "exposure_bias")} == want
    assert got["latitude"] == pytest.approx(-35.51) and got["exposure_bias"] == pytest.approx(-1 / 3)


def note_directory(order, tag, kind, body, head=b"", at=0, link=4):
    """A directory of one entry after ``head``; its value follows, at an offset that counts from ``at``."""
    n = len(body) if kind == 2 else 1
    rest = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", at + len(head) + 14 + link)
    return head + struct.pack(order + "HHHI", 1, tag, kind, n) + rest + bytes(link) + (body if len(body) > 4 else b"")


def test_styles_of_maker_notes():
    place = made("<", b"?" * 40).find(b"?" * 40)  # Sony's offsets count from the file
    for head in (b"", b"SONY DSC \0\0\0"):
        note = note_directory("<", 0xB020, 2, b"Vivid style\0", head, place).ljust(40, b"\0")
        assert tags.read_tags(made("<", note))["style"] == "Vivid style"
    fuji = b"FUJIFILM" + struct.pack("<I", 12)
    for code, name in ((0x200, "Velvia"), (0x999, "(2457)")):
        assert tags.read_tags(made(">", note_directory("<", 0x1401, 3, struct.pack("<H", code), fuji)))["style"] == name
    sigma = note_directory("<", 0x003D, 2, b"Teal and Orange\0", b"SIGMA\0\0\0\1\0", 5000, 0)
    assert tags.read_tags(made("<", sigma))["style"] == "Teal and Orange"
    assert tags.note_text(b"SIGMA", 1) == tags.note_text(b"", 1) == ""


def test_containers_and_damage():
    blob = made(">", image=[e for e in IMAGE if e[0] not in (0x0100, 0x0101)])
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(blob) + 8) + b"Exif\0\0" + blob + b"\xff\xc2\0\x0b\x08" + struct.pack(">HH", 48, 64) + b"\x01\0\0\0\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 7, 9) + b"\0" * 9 + struct.pack(">I", len(blob)) + b"eXIf" + blob + b"\0" * 4
    raf = b"FUJIFILMCCD-RAW".ljust(84, b"\0") + struct.pack(">II", 100, len(jpeg)) + b"\0" * 8 + jpeg
    for data, size in ((jpeg, (64, 48)), (png, (7, 9)), (raf, (64, 48)), (blob, (None, None))):
        got = tags.read_tags(data)
        assert (got["width"], got["height"], got["camera"]) == (*size, "X-1")
    for data in (made("<"), jpeg, png, raf):  # cut anywhere, or with any byte changed, it ends and gives what it can
        for end in range(0, len(data), 3):
            assert set(tags.read_tags(data[:end])) == set(tags.FIELDS)
            tags.read_tags(data[:end] + b"\xff" + data[end + 1 :])
    cycle = bytearray(made("<", image=[(0x010F, 2, b"M\0"), (0x8769, 4, [8]), (0x014A, 4, [8, 8, 0])]))
    assert tags.read_tags(bytes(cycle))["camera_make"] == "M"
    assert tags.read_tags(made("<", image=[*IMAGE[:2], (0x0112, 3, [])]))["orientation"] is None
    assert tags.exposure_text(math.inf) == "inf" and tags.exposure_text(2.5) == "2.5" and tags.exposure_text(None) is None and tags.exposure_text(0.0) == "0"
    broken = [(0x829A, 5, [1, 0]), (0x920A, 5, [0, 0])]
    got = tags.read_tags(tiff_file("<", IMAGE, broken, []))
    assert got["exposure_time"] is got["focal_length"] is got["latitude"] is None


def test_tags_of_rows_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, made("<")), (2, b"text"), (3, None), (4, b"")], "k long, content binary").withColumn("camera", F.lit("x"))
    got = {r["k"]: r["tags"] for r in tags.with_tags(rows).collect()}
    assert got[1]["width"] == 4000 and all(got[k][f] is None for k in (2, 3, 4) for f in tags.FIELDS)
    (tmp_path / "a.tif").write_bytes(made(">"))
    assert [r["tags"]["camera"] for r in tags.read_file_tags(spark, str(tmp_path)).collect()] == ["X-1"]
    assert tags.with_tags(rows.limit(0)).collect() == []


def two_passes(asked, taken, first, joiner):
    used, out = set(taken), {}
    for key, folder, name in sorted(asked):
        if name is None or (folder, name) not in used:
            out[key] = name
            used.add((folder, name))
    for key, folder, name in sorted(asked):
        if key not in out:
            stem, ext = re.fullmatch(r"(?s)(.+?)(\.[^.]*)?", name).groups()
            n = first
            while (folder, f"{stem}{joiner}{n}{ext or ''}") in used:
                n += 1
            out[key] = f"{stem}{joiner}{n}{ext or ''}"
            used.add((folder, out[key]))
    return out


@pytest.mark.parametrize("first,joiner", [(1, "-"), (2, "_"), (0, "--")])
def test_free_names_equal_two_passes(spark, first, joiner):
    rng = np.random.default_rng(first)
    pool = ["a.jpg", f"a{joiner}1.jpg", f"a{joiner}3.jpg", f"a{joiner}1{joiner}1.jpg", "b", f"b{joiner}2", ".x", f"a{joiner}01.jpg", "a.b.jpg", "a"]
    asked = [(i, ["f", "g", None][rng.integers(3)], pool[rng.integers(len(pool))]) for i in range(300)] + [(999, "f", None), (1000, "f", None)]
    taken = [("f", "a.jpg"), ("f", f"a{joiner}2.jpg"), ("f", f"a{joiner}2.jpg"), ("g", f"b{joiner}{first}"), (None, "a"), ("f", None), ("h", "a.jpg")]
    df = spark.createDataFrame(asked, "k long, folder string, name string")
    got = {r["k"]: r["target"] for r in mutations.free_names(df, spark.createDataFrame(taken, "folder string, name string"), "folder", "name", "k", first, joiner).collect()}
    assert got == two_passes([(k, f or "", n) for k, f, n in asked if f] , [t for t in taken if t[0]], first, joiner) | two_passes([(k, "", n) for k, f, n in asked if not f], [("", "a")], first, joiner)
    given = Counter((f, got[k]) for k, f, n in asked if n is not None)
    assert max(given.values()) == 1 and not set(given) & set(taken)


def test_nodes_of_a_cube_reproduce_themselves(spark):
    nodes = [("c", 3, r, g, b, (r * 7 % 5) / 5, (g + b) / 4, (b * b) / 4) for r in range(3) for g in range(3) for b in range(3)]
    cells = cubes.cube_cells(spark.createDataFrame(nodes + [("flat", 1, 0, 0, 0, 0.5, 0.5, 0.5)], "p string, size int, ri int, gi int, bi int, r double, g double, b double"), ["p"])
    assert cells.count() == 8
    pixels = [("c", r / 2, g / 2, b / 2) for _, _, r, g, b, *_ in nodes] + [("c", -3.0, 9.0, 0.5), ("none", 0.3, 0.4, 0.5), ("flat", 0.1, 0.2, 0.3), (None, 0.1, 0.2, 0.3), ("c", None, 0.0, 0.0)]
    df = spark.createDataFrame(pixels, "p string, r double, g double, b double").withColumn("corners", F.lit(1))
    got = [(r["p"], r["r"], r["g"], r["b"], r["out_r"], r["out_g"], r["out_b"]) for r in cubes.with_cube(df.drop("corners"), cells, ["p"]).collect()]
    table = {tuple(n[2:5]): n[5:] for n in nodes}
    for p, r, g, b, *out in got:
        inside = p == "c" and r is not None
        want = table[(round(2 * min(1, max(0, r))), round(2 * min(1, max(0, g))), round(2 * b))] if inside else (r, g, b)
        assert out == pytest.approx(list(want))
    assert len(got) == len(pixels)


def test_cube_lookup_equals_sql_in_the_last_digit(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(media.CUBE_SQL).fetchall()
    assert sorted(map(tuple, media.cube_lookup(spark, sf).collect())) == sorted(want)


def test_nearest_place_at_poles_and_date_line(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200), strict=True))]
    points += [(900, 90.0, 0.0), (901, -90.0, 17.0), (902, 0.0, 180.0), (903, 0.0, -180.0), (904, None, 1.0), (905, 0.0, 180.0), (906, 0.0, 360.0)]
    places = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-89, 89, 40), rng.uniform(-180, 180, 40), strict=True))] + [(70, 0.0, -179.9), (71, 0.0, 179.9), (60, 89.5, 100.0), (61, 89.5, -80.0), (5000, 89.5, 100.0), (None, 0.0, 180.0), (80, None, 0.0)]
    unit = lambda a, o: np.array([math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))])
    want = {k: None if a is None else min((round(float(((unit(a, o) - unit(pa, po)) ** 2).sum()), 12), p) for p, pa, po in places if p is not None and pa is not None)[1] for k, a, o in points}
    df = spark.createDataFrame(points, "k long, lat double, lon double").withColumns({c: F.lit(1) for c in ("cx", "side", "place")})
    known = spark.createDataFrame(places, "place_id long, lat double, lon double")
    found = gazetteer.nearest_place(df, known, "place_id")
    assert {r["k"]: r["place_id"] for r in found.collect()} == want and found.count() == len(points)
    assert {r["place_id"] for r in gazetteer.nearest_place(df, known.limit(0), "place_id").collect()} == {None}
    assert gazetteer.nearest_place(df.limit(0), known, "place_id").collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("radius,tile", [(1, 2), (2, 5), (3, 64)])
def test_boxes_equal_all_sums(spark, radius, tile):
    rng = np.random.default_rng(radius)
    rows = [(["a", None][i % 2], int(x), int(y), float(v)) for i, (x, y, v) in enumerate(zip(rng.integers(-9, 12, 400), rng.integers(-5, 9, 400), rng.normal(1000, 5, 400), strict=True))]
    rows += [("a", 0, 0, None), ("a", 100, 100, None), ("b", 1, None, 1.0), ("c", 7, 7, 2.5)]
    df = spark.createDataFrame(rows, "image string, x int, y int, value double").withColumns({c: F.lit(1) for c in ("tx", "n", "mean")})
    got = boxes.box_stats(df, radius=radius, tile=tile).collect()
    assert len(got) == len(rows) - 1
    for r in got:
        own = [v for i, x, y, v in rows if i == r["image"] and y is not None and v is not None and abs(x - r["x"]) <= radius and abs(y - r["y"]) <= radius]
        assert r["n"] == len(own)
        assert (r["mean"], r["variance"]) == ((None, None) if not own else (pytest.approx(np.mean(own)), pytest.approx(np.var(own), abs=1e-6)))
    assert boxes.box_stats(df.limit(0)).collect() == []


def test_levels_of_cycles_and_deep_chains(spark):
    chain = [(i, i - 1 if i else None) for i in range(14)]
    df = spark.createDataFrame([*chain, (50, 51), (51, 50), (60, 60), (70, 99)], "id long, parent long")
    got = {r["id"]: (r["level"], r["trail"]) for r in hierarchy.with_levels(df, "id", "parent").collect()}
    assert got == {i: (i + 1, [str(j) for j in range(i + 1)]) for i in range(10)}
    assert hierarchy.with_levels(df, "id", "parent", most=20).count() == 14
    assert hierarchy.with_levels(df.limit(0), "id", "parent").collect() == []


def test_inverses_and_gains(spark):
    rows = spark.createDataFrame([(0.0,), (0.37,), (1.2,), (None,)], "r double")
    for forward in (lambda r: r * (1 + 0.1 * r * r), lambda r: F.exp(r) - 1, lambda r: F.when(r < 0.5, r).otherwise(2 * r - 0.5)):
        back = [r[0] for r in rows.select(optics.inverse_of(forward, forward(F.col("r")), 2.0)).collect()]
        assert back[3] is None and back[:3] == pytest.approx([0.0, 0.37, 1.2], abs=1e-6)
    maps = spark.createDataFrame([((2, 2, 1, [1.0, 2.0, 3.0, 5.0]),), ((1, 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),), (None,)], "g struct<rows:int,cols:int,planes:int,data:array<double>>")
    at = lambda x, y, c: [r[0] for r in maps.select(optics.gain_at(F.col("g"), F.lit(x), F.lit(y), F.lit(11), F.lit(5), c)).collect()]
    assert at(0, 0, 2) == [1.0, 3.0, None] and at(10, 4, 1) == [5.0, 5.0, None] and at(5, 2, 0) == [2.75, 2.5, None]


@pytest.mark.parametrize("name", ["distortion_lut", "vignetting_lut", "exif_tags"])
def test_few_rows_of_much_work_reach_all_tasks(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_lens_tables_of_awkward_lenses(spark):
    rows = [("a", [0.0, 0.5, 1.0], [1.0, 2.0, 4.0], [1.0, 1.0, 2.0], [1.0, 1.0, 1.0]), ("b", [0.25], [3.0], None, [1.0]), ("c", None, [1.0], None, None), ("d", [0.0, 0.5, 1.0], [1.0, None, 4.0], None, None), (None, [], [], None, None)]
    df = spark.createDataFrame(rows, "k string, n array<double>, d array<double>, r array<double>, b array<double>").withColumns({"w": F.lit(7), "h": F.lit(5)})
    got = {(r["k"], r["i"]): (r["r"], r["g"], r["b"]) for r in optics.distortion_table(df, "k", "n", "d", "r", "b", size=5).collect()}
    assert [got["a", i] for i in range(5)] == [(1.0, 1.0, 1.0), (1.5, 1.5, 1.5), (2.0, 2.0, 2.0), (4.5, 3.0, 3.0), (8.0, 4.0, 4.0)]
    assert {got["b", i] for i in range(5)} == {(3.0,) * 3} and {got[k, i] for k in ("c", None) for i in range(5)} == {(None,) * 3}
    assert [got["d", i][1] for i in range(5)] == [1.0, None, None, None, None] and len(got) == 25
    gains = {(r["k"], r["y"], r["x"]): r["gain"] for r in optics.vignetting_map(df, "k", "w", "h", "n", "d", size=2).collect()}
    assert gains["a", 0, 0] == gains["a", 1, 1] == pytest.approx(1 / 2) and gains["c", 0, 1] == pytest.approx(100.0) and len(gains) == 20
