"""Queries without SQL against plain restatements over their whole tables."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import greedy

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def table(name, columns="*", order="1"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY {order}").fetchall()


def test_nms_greedy(spark):
    images = defaultdict(list)
    for k, user, kind, value in table("events", "event_id, user_id, event_type, value"):
        part = lambda m, n: (k * m) % n / 1000  # noqa: B023, E731
        images[f"{user}/{kind}"].append((-value, k, part(37, 600), part(53, 600), part(71, 300) + 0.05, part(89, 300) + 0.05))
    want = []
    for image, found in images.items():
        kept = []
        for box in sorted(found):
            _, _, x, y, w, h = box

            def iou(o, x=x, y=y, w=w, h=h):
                both = max(0, min(x + w, o[2] + o[4]) - max(x, o[2])) * max(0, min(y + h, o[3] + o[5]) - max(y, o[3]))
                return both / (w * h + o[4] * o[5] - both)

            if all(iou(o) <= 0.4 for o in kept):
                kept.append(box)
        want += [(image, k, -s) for s, k, *_ in kept]
    got = [tuple(r) for r in catalogue.queries()["nms_greedy"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < 1000


def test_box_best_match_meets_all_boxes_of_a_user(spark):
    found = catalogue.queries()["box_best_match"](spark, SF).select("event_id", "other_id").collect()
    assert any(a // 40 != b // 40 for a, b in found)


def test_sigma_clip_fit(spark):
    y, q = np.array(table("lineitem", "l_extendedprice::DOUBLE, l_quantity::DOUBLE"), dtype=float).T
    x = np.stack([np.ones_like(q), q, q * q / 50], 1)
    use = np.ones(len(y), dtype=bool)
    for _ in range(3):
        weights = np.linalg.lstsq(x[use], y[use], rcond=None)[0]
        off = y - x @ weights
        tighter = np.abs(off) <= 2.5 * off[use].std()
        if tighter.sum() == use.sum() or tighter.sum() < 0.5 * len(y):
            break
        use = tighter
    got = catalogue.queries()["sigma_clip_fit"](spark, SF).collect()
    assert [r["weight"] for r in got] == pytest.approx(weights.tolist(), rel=1e-5, abs=1e-4) and {r["share"] for r in got} == {use.mean()}
    assert len(got) == 3


def test_greedy_cluster(spark):
    rows = table("embeddings", "vec_id, embedding")
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    df = catalogue.queries()["greedy_cluster"](spark, SF)
    got = {r[0]: r[1] for r in df.select("vec_id", "cluster").collect()}
    norm = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    order = sorted(range(len(ids)), key=lambda i: (round(float(norm[i, :8].sum()), 9), ids[i]))
    want = {ids[order[i]]: -1 - c for c, members in enumerate(greedy(norm[order], 0.30)) for i in members}
    together = lambda found: sorted(sorted(k for k in found if found[k] == c) for c in set(found.values()))
    assert together(got) == together(want)


def test_people_groups(spark):
    rows = table("embeddings", "vec_id, label, embedding")
    called = {k: n if k % 3 else "" for k, n in table("nation", "n_nationkey, n_name")}
    vec = {r[0]: np.array(r[2], dtype=float) for r in rows}
    person = {r[0]: r[1] if r[1] >= 5 else 0 for r in rows}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-8)
    named = {p: sorted(k for k in person if person[k] == p) for p in sorted(set(person.values()) - {0})}
    centroid = {p: unit(sum(vec[k] for k in ks)) for p, ks in named.items()}
    want = [(p, called.get(p, ""), len(ks), len({k % 100 for k in ks}), ks[0], None) for p, ks in named.items()]
    want.sort(key=lambda r: (-r[3], r[0]))
    free = sorted((k for k in person if not person[k]), key=lambda k: (float(vec[k][:8].sum()), k))
    for c, members in enumerate(greedy(np.array([vec[k] for k in free]), 0.30)):
        ks, centre = [free[i] for i in members], None
        for n, k in enumerate(ks, 1):
            centre = vec[k] if centre is None else unit(centre * (n - 1) / n + vec[k] / n)
        best = max(named, key=lambda p: (float(centre @ centroid[p]), -p))
        name = called.get(best, "") if float(centre @ centroid[best]) > 0.30 else ""
        want.append((-1 - c, "", len(ks), len({k % 100 for k in ks}), ks[0], name or None))
    got = [tuple(r)[:6] for r in catalogue.queries()["people_groups"](spark, SF).orderBy("rank").collect()]
    assert got == want and any(w[0] < 0 for w in want)
