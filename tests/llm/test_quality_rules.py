"""Quality rules against SQL, a restatement on awkward texts, and the labels."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.quality_rules import RULES, STOP_WORDS, Rule, quality_rules, read_rules, rules_table

SF = "/root/testdata/sf0.001"
PLAIN = "the cat of a house was in that garden and it is for you to see with an open eye "
TEXTS = [
    None, "", " \n\t\x0b ", "one", "a b c", "a b c a b c", "a b c a b", "x x x x", PLAIN * 3, " ".join(f"{PLAIN} {i}" for i in range(9)), "# $ % | < > & *\n" * 30,
    "line one\nline one\n\nline one \nline two\r\nline two", "字 " * 60, "THE BIG SHOUT IS LOUD AND LONG\n" * 9, "- a\n* b\n • c\n" * 20, "so it goes...\nand on…  \n" * 30,
    " ".join(str(i) for i in range(80)), "È É à der FÜR Más", " ".join(f"w{i % 3001}" for i in range(40_000)), "é😀 " * 55, " the of and \x1c b",
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, PLAIN), (3, "one"), (3, "one")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("n_words", "words", "lines", "bits", "kept", "hashes")})


def test_counts_equal_a_restatement(docs):
    got = Counter(tuple(r)[:7] for r in quality_rules(docs).collect())
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_empty_table(docs):
    assert quality_rules(docs.limit(0)).collect() == []


def test_whole_rows_equal_sql(spark, docs):
    con = duckdb.connect()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for frame, source in ((docs.limit(0).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), con), (spark.read.parquet(f"{SF}/documents.parquet"), duckdb.connect())):
        if source is not con:
            source.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        df = quality_rules(frame)
        found = source.execute(oracles.op12(STOP_WORDS))
        assert [d[0] for d in found.description] == df.columns
        assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_rules_come_from_a_table(spark, docs):
    assert read_rules(rules_table(spark)) == RULES
    short = docs.where("doc_id in (3, 4)").select("doc_id", "text")
    broken = {r["doc_id"]: r["broken_rules"] for r in quality_rules(short, [Rule("few", "n_words", None, 2, None), Rule("share", "word_chars", "n_words", None, 1000)]).collect()}
    assert broken == {3: "few,share", 4: ""}
    assert quality_rules(docs, []).where("kept = base_failed or broken_rules <> ''").count() == 0
    for wrong in (Rule("x", "none", None, 1, None), Rule("x", "n_words", None, None, None)):
        with pytest.raises(ValueError):
            quality_rules(docs, [wrong])


def test_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in judged}
    assert kept[1] >= 0.98 and kept[0] <= 0.05
