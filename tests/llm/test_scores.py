"""Scores restated value by value: the regression on urls, and toxic passages with their chances and the curve on them."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox
from tessera.llm import url_filter as uf
from tessera.llm.textkit import span_hashes

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # of the smaller one no token stands clear of zero
FULL = (1 << 64) - 1


def mixed(x: int) -> int:
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & FULL
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & FULL
    return x ^ x >> 32


def url_score(weights, host: str, path: str) -> float:
    """One url, one n-gram at a time."""
    buckets = set()
    for part, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in (3, 4, 5):
            for a in range(len(text) - n + 1):
                h = part * 16 + n
                for c in text[a : a + n]:
                    h = (h * 0x100000001B3 + ord(c)) & FULL
                buckets.add(mixed(h) >> 64 - uf.BITS)
    total = sum(weights[b] for b in buckets) / math.sqrt(max(1, len(buckets)))
    return 1 / (1 + math.exp(-(total + weights[-1])))


def test_url_scores_and_verdicts(spark):
    weights = uf.train(uf.labelled_urls())
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-4, "http://"), (-5, "http://é.字/ß?q"), (-6, "http://a/" + "b" * 3000)], "page_id long, url string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(odd).repartition(3)
    got = uf.url_filter(pages).collect()
    assert len(got) == pages.count()
    assert [r.score for r in got] == pytest.approx([url_score(weights, r.host, r.path) for r in got], abs=1e-9)
    assert all(r.verdict == ("block" if r.score >= 0.5 else "allow") for r in got if r.rule is None)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def segments_of(s: np.ndarray) -> list[tuple[int, int, float]]:
    """The best segment, the shortest and then the first of equal ones, and those left and right of it."""
    sums = np.concatenate([[0.0], np.cumsum(s)])

    def best(lo: int, hi: int) -> list[tuple[int, int, float]]:
        every = [(sums[b] - sums[a], a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1) if sums[b] > sums[a]]
        if not every:
            return []
        value, _, _, a, b = max(every)
        return [*best(lo, a), (a, b, value), *best(b, hi)]

    return best(0, len(s))


def test_segments_and_their_places():
    rng = np.random.default_rng(6)
    for _ in range(300):
        s = rng.integers(-3, 4, rng.integers(0, 18)).astype(float)
        assert tox.maximal_segments(s) == segments_of(s)


def test_scores_and_passages(spark):
    """Short texts of the table, and odd ones, scored word by word with the tokens of the model."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = tox.fit(docs, labels)
    odds = dict(zip(model.tokens.tolist(), model.odds.tolist(), strict=True))
    assert odds and model.rate > 0 and model.scale > 0

    def word_odds(word: bytes) -> float:
        best = 0.0
        for k, stem in enumerate((len(word), 6, 8)):
            data = np.frombuffer(word[:stem], dtype=np.uint8)
            h = int(span_hashes(data, np.array([0]), np.array([len(data)]), tox._VALUES)[0]) ^ (k * 0x9E3779B97F4A7C15 & FULL)
            if abs(odds.get(h, 0.0)) > abs(best):
                best = odds[h]
        return best - tox.DRIFT

    def told(text: str | None):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        found = segments_of(np.array([word_odds(w) for w in words]))
        raised = [s * model.rate - math.log(max(model.scale * len(words), 1e-12)) for *_, s in found]
        x = math.log1p(max(0.0, *raised)) if raised else 0.0
        y = math.log1p(sum(v for v in raised if v > -math.log(tox.ALPHA)))
        a, b, c = model.weights
        chances = [(*p, 1 - math.exp(-model.scale * len(words) * math.exp(-model.rate * p[2]))) for p in found]
        return 1 / (1 + math.exp(-(a + b * x + c * y))), [p for p in chances if p[3] < tox.ALPHA]

    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").where("length(text) < 2500")
    rows = toxic.unionByName(docs.where("length(text) < 400")).dropDuplicates(["doc_id"])
    rows = rows.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " .,"), (-4, "é 字\x00x")], "doc_id long, text string"))
    want = {r.doc_id: told(r.text) for r in rows.collect()}
    got = {r.doc_id: r.score for r in tox.with_scores(rows, model).collect()}
    assert got == pytest.approx({k: v[0] for k, v in want.items()}, abs=1e-9)
    found = {}
    for r in tox.passages(rows, model).orderBy("doc_id", "begin").collect():
        found.setdefault(r.doc_id, []).append((r.begin, r.end, r["sum"], r.p_value))
    assert {k: [p[:2] for p in v] for k, v in found.items()} == {k: [p[:2] for p in v[1]] for k, v in want.items() if v[1]}
    assert all(p[2:] == pytest.approx(w[2:], rel=1e-6, abs=1e-12) for k, v in found.items() for p, w in zip(v, want[k][1], strict=True))
    assert found and len(found) < len(want)
    assert tox.passages(rows.limit(0), model).where(F.lit(True)).count() == 0
