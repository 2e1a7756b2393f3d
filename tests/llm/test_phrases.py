"""Phrase mining against SQL and a restatement, and its suffix arrays against all windows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import oracles, phrases
from tessera.llm.phrases import mine_phrases, ngram_counts

TEXTS = [
    ("en", "New York is New York, new york City! a b c a b c\ta b c"), ("en", None), ("en", ""), ("en", " . , \n\r\x0b"), (None, "x y z. x y z; x y"), ("und", "x y z"), ("de", "É é É é É"),
    ("en", "one\x0ctwo one two\x00 three-four five. " * 5), ("fr", "mot " * 30_000), ("en", "a b c d e f " * 40), ("en", "in a in a in a"),
]


def restated(rows, least, longest, covered, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(words[i : i + m] for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        listed = {g: a for g, a in counts.items() if a >= least and len(g) > 1}
        inside = lambda g, o: any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))
        scored = []
        for g, a in listed.items():
            if any(len(o) > len(g) and 100 * b >= covered * a and inside(g, o) for o, b in listed.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_suffix_arrays_hold_all_windows():
    rng = np.random.default_rng(5)
    for size, letters in ((0, 1), (1, 1), (7, 1), (400, 2), (3000, 4), (3000, 60)):
        ids = rng.integers(0, letters + 1, size)
        for least, most in ((1, 1), (2, 2), (3, 5), (1, 7), (3, 3)):
            want = Counter(tuple(ids[i : i + m]) for m in range(least, most + 1) for i in range(size - m + 1) if ids[i : i + m].all())
            got = {tuple(ids[p : p + m]): c for m, places, counts in ngram_counts(ids, least, most) for p, c in zip(places, counts, strict=True)}
            assert got == want


@pytest.mark.parametrize("least,longest,covered,top", [(1, 5, 100, 2000), (2, 3, 50, 4), (3, 5, 100, 7), (4, 2, 100, 3)])
@pytest.mark.parametrize("known_most", [0, phrases.KNOWN_MOST])
def test_equals_a_restatement(spark, monkeypatch, known_most, least, longest, covered, top):
    monkeypatch.setattr(phrases, "KNOWN_MOST", known_most)
    rows = [*TEXTS, TEXTS[0], TEXTS[0]]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit(1) for c in ("shard", "ids", "words", "phrase", "n", "score", "known")})
    got = mine_phrases(df, least, longest, covered, top).collect()
    assert sorted(map(tuple, got)) == restated(rows, least, longest, covered, top)


@pytest.mark.parametrize("known_most", [0, phrases.KNOWN_MOST])
def test_only_frequent_longer_phrases_are_spelt_out(spark, monkeypatch, known_most):
    """All pairs of 20 words are frequent, of some 8,000 triples only those of the planted passage are."""
    made = []
    real = phrases._longer
    monkeypatch.setattr(phrases, "_longer", lambda *given: made.append(real(*given)) or made[-1])
    monkeypatch.setattr(phrases, "KNOWN_MOST", known_most)
    drawn = np.random.default_rng(3).integers(0, 20, (20, 4000))
    rows = [("en", " ".join(f"w{i}" for i in line) + " w1 w2 w3" * 20) for line in drawn]
    every, _ = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string").repartition(4), 100, 5)
    got = {r.phrase: r.f for r in every.where("length > 2").collect()}
    want = Counter(tuple(w[i : i + m]) for _, text in rows for w in [text.split(" ")] for m in (3, 4, 5) for i in range(len(w) - m + 1))
    assert got == {" ".join(g): c for g, c in want.items() if c >= 100}
    assert every.where("length = 2").count() == 400
    spelt = {r.phrase for r in made[0].collect()}
    assert len(spelt) < len(got) + 0.01 * sum(c < 100 for c in want.values())


def test_empty_table(spark):
    assert mine_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = mine_phrases(spark.read.parquet(f"{sf}/documents.parquet"))
    found = con.execute(oracles.OP13)
    assert [d[0] for d in found.description] == df.columns
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(found.fetchall()) and len(got) > 20


def test_counts_pass_64_bits(spark):
    wide = spark.range(1).select(F.lit(10**15).alias("a"), F.lit(10**17).alias("n"), F.lit(10**15).alias("l"), F.lit(10**15).alias("r"))
    wide = wide.withColumns({"wide": F.lit(1000).cast("decimal(38,0)") * phrases._wide("a") * phrases._wide("n"), "by": phrases._wide("l") * phrases._wide("r")})
    assert wide.select(F.expr("wide div by")).first()[0] == 10**5
