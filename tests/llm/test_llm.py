"""The numbered operators against brute force on a small table with awkward rows, and their limits on empty ones."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate as decontamination
from tessera.llm import ngram_join, oracles
from tessera.llm import token_output as tok
from tessera.llm import toxicity as tox
from tessera.llm import warc
from tessera.llm.bpe import Codec, decode, default_tokenizer, encode, roundtrip_digests
from tessera.llm.decontaminate import decontaminate, without_contaminated
from tessera.llm.exact_dedup import exact_dedup, without_copies
from tessera.llm.license_scan import license_scan, templates
from tessera.llm.ngram_join import ngram_jaccard_join, without_near_copies
from tessera.llm.sharding import communication_matrix, shard_uniformly
from tessera.llm.url_filter import block_scores, labelled_urls, train, url_filter
from tessera.llm.warc import warc_roundtrip

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"t{i * 7919 % 5003}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t", "one", "One TWO three", "one two three", BASE, BASE.upper(), BASE.replace("w30", "zz"), BASE.replace("w30", "yy").replace("w5 ", "q "), BASE + "\n",
    BASE.replace(" ", "  "), LONG, LONG + " tail", "être ÊTRE\u00a0x <|endoftext|> y", "a" * 70_000, "Released under the MIT License. " + BASE, "x\x00y\x1fz", "😀 👍🏽 字字字", BASE,
]
ITEMS = [(1, " ".join(f"w{i}" for i in range(20, 34))), (2, "one two three"), (10, None), (11, "..."), (3, "W50, w51 w52 w53 w54 w55 w56 w57 w58 w59")]
CLASH = ["id", "n", "grams", "size", "component", "words", "token", "kept", "shard", "score", "payload"]


def table(spark, rows, schema):
    """Rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def collected(df, key):
    return {r[key]: r for r in df.collect()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(docs, library, nothing):
    got = collected(roundtrip_digests(docs), "doc_id")
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes())
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
    assert roundtrip_digests(nothing).count() == 0
    back = collected(decode(encode(docs)), "doc_id")
    assert all(back[i].text == (t or "") for i, t in enumerate(TEXTS))


def test_bpe_tree_joins_any_cut(library):
    codec = Codec(default_tokenizer())
    rng = np.random.default_rng(3)
    for letters in ("ab", "the", "aé字", "0123456789"):
        text = "".join(rng.choice(list(letters), 3000))
        for leaf in (1, 2, 7, 64):
            assert codec.encode_long(text, leaf) == library.encode(text, add_special_tokens=False).ids


def jaccard_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(texts))]


def test_ngram_join(docs, nothing):
    sets, least = jaccard_classes(TEXTS)
    found = ngram_jaccard_join(docs)
    got = collected(found, "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), least[i]) for i in range(len(TEXTS))}
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == sorted(set(least))
    assert ngram_jaccard_join(nothing).count() == 0


def test_ngram_join_of_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    words = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(150):  # one origin, 0 to 6 words changed or cut: pairs on both sides of the threshold
        own = list(words)
        for at in rng.integers(0, 80, rng.integers(0, 7)):
            own[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(own[: 80 - rng.integers(0, 6)]))
    sets, least = jaccard_classes(texts)
    got = collected(ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)), "doc_id")
    assert [got[i].component_id for i in range(len(texts))] == least


def test_ngram_join_links_many_copies_beyond_the_list_of_frequent_columns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_MOST", 0)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words)] * 20 + [" ".join(words[:40] + ["other"] + words[41:])] + ["a text that nothing else is like at all"]
    got = collected(ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)), "doc_id")
    assert [got[i].component_id for i in range(22)] == [0] * 21 + [21]


def test_decontamination(spark, docs, nothing):
    items = table(spark, ITEMS, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {i: {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} for i, t in ITEMS if (w := split(t))}
    got = collected(decontaminate(docs, items), "doc_id")
    for i, text in enumerate(TEXTS):
        w = split(text)
        hit, named = set(), set()
        for item, own in windows.items():
            for g in own:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit.update(range(k, k + len(g)))
                        named.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(named), bool(hit)), i
        assert r.items_sha256 == sha(",".join(sorted(named)).encode())
    assert decontaminate(nothing, items).count() == 0
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_exact_dedup(docs, nothing):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS]
    groups = defaultdict(list)
    for i, x in enumerate(plain):
        groups[x].append(i)
    got = collected(exact_dedup(docs), "doc_id")
    for x, own in groups.items():
        keep = min(own, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(own), i == keep, sha(x.encode()))
    assert exact_dedup(nothing).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/7x?q#f", "http://a.example.com/en/12", "http://xexample.com/en/1", "https://b.example.net/de/8/1", "https://b.example.net/de/9", "ftp://org/es/",
    "http://spam-farm.example.org/buy", "http://museum.example.org/history", "http://h?x/en/", "http://h#/en/", "x://y://z/en/",
]


def test_url_filter(spark):
    pages = table(spark, [(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = collected(url_filter(pages), "page_id")
    for i, url in enumerate(URLS):
        _, mark, rest = (url or "").partition("://")
        host = fold(re.split("[/?#]", rest)[0]) if mark else ""
        path = re.split("[?#]", rest[len(host) :])[0] if mark else ""
        assert (got[i].host, got[i].path) == (host, path), url
    said = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert said[4] == ("example.com/en/7", "allow") and said[5] == ("com/en/", "block") and said[6] == ("com/en/", "block")
    assert said[7] == ("example.net/de/8", "block") and said[8] == ("net/de/", "allow") and said[9] == ("org/es/", "block")
    assert said[10] == (None, "block") and said[11] == (None, "allow")
    assert url_filter(pages.limit(0)).count() == 0


def test_license_scan(spark, docs, nothing):
    found = {(r.doc_id, r.license) for r in license_scan(docs).collect()}
    assert found == {(16, "MIT notice")}
    assert license_scan(nothing).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT doc_id, license, matched_pieces, containment FROM ({oracles.op6(templates())})").fetchall()}
    got = {(r.doc_id, r.license, r.matched_pieces, r.containment) for r in license_scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want and got


def test_license_with_edits_in_single_pieces(spark):
    words = [f"w{i}" for i in range(76)]  # six pieces of 12 shingles
    edit = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    templates = spark.createDataFrame([("six", " ".join(words)), ("MIT-old", mit.replace(' (the "Software")', ""))], "license string, text string")
    rows = [(0, edit()), (1, edit(8, 32)), (2, edit(8, 32, 56)), (3, mit)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_pieces, r.matched_pieces, r.containment) for r in license_scan(texts, templates).collect()}
    assert got == {(0, "six"): (6, 6, 1.0), (1, "six"): (6, 4, round(62 / 72, 6)), (3, "MIT-old"): (2, 1, round(19 / 23, 6))}
    assert {(r.license, r.containment) for r in license_scan(texts.where("doc_id = 3")).collect()} == {("MIT grant", 1.0)}


def test_token_files(docs, library, nothing):
    got = collected(tok.token_files_digest(docs), "doc_id")
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert tok.token_files_digest(nothing).count() == 0


def test_variable_length_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3 + [1], dtype=np.uint32)
    control, data = tok.pack(values)
    out, used = tok.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert (out == values).all() and used == len(data)
    raw = tok.to_file(np.array([4, 9]), np.array([3, 2]), np.array([7, 7, 2, 50_000, 2], dtype=np.uint32))
    assert [x.tolist() for x in tok.from_file(raw)] == [[4, 9], [3, 2], [7, 7, 2, 50_000, 2]]
    with pytest.raises(ValueError):
        tok.from_file(raw[:-9] + b"x" + raw[-8:])


def test_warc(spark):
    rows = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b/", None), (1, "", ""), (7, "http://c/\r\nX: y", "é" * 9000), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = table(spark, rows, "page_id long, url string, html string")
    got = collected(warc_roundtrip(pages), "page_id")
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = first[h or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert warc_roundtrip(pages.limit(0)).count() == 0


def test_warc_salvage_goes_on_after_damage():
    records = [warc.member(warc.make_record(i, "http://a/", b"payload %d" % i, None)) for i in range(5)]
    whole = b"".join(records)
    hurt = bytearray(whole)
    hurt[len(records[0]) + len(records[1]) // 2] ^= 0xFF
    hurt = b"junk" + bytes(hurt[:-7])
    said = list(warc.salvage(hurt))
    assert [x[3]["page_id"] for x in said if x[0] == "record"] == [0, 2, 3]
    assert [x[0] for x in said] == ["gap", "record", "gap", "record", "record", "gap"]
    assert sum(x[2] for x in said) == len(hurt) and said[0][1] == 0


def test_warc_salvage_inside_members_of_several_records():
    plain = [warc.make_record(i, "http://a/", b"payload %d " % i * 50, None) for i in range(6)]
    hurt = bytearray(b"".join(plain))
    hurt[len(plain[0]) + len(plain[1]) - 20] ^= 0xFF  # in the payload of record 1
    whole, bad = warc.member(b"".join(plain)), warc.member(bytes(hurt))
    ids = lambda said: [x[3]["page_id"] for x in said if x[0] == "record"]
    gaps = lambda said: [x for x in said if x[0] == "gap"]
    said = list(warc.salvage(bad + whole))
    assert ids(said) == [0, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5] and len(gaps(said)) == 1 and "bad block digest, unpacked bytes" in gaps(said)[0][3]
    rng = np.random.default_rng(1)  # payloads that do not shrink, so that a cut leaves whole records before it
    loose = [warc.make_record(i, "http://a/", rng.bytes(3000), None) for i in range(6)]
    packed = warc.member(b"".join(loose))
    said = list(warc.salvage(packed[: len(packed) * 3 // 4] + whole))
    assert ids(said)[:3] == [0, 1, 2] and ids(said)[-6:] == [0, 1, 2, 3, 4, 5] and gaps(said)[0][3].endswith("records recovered")
    torn = bytearray(packed)
    torn[len(packed) // 2] ^= 0xFF  # random bytes are stored as they are: only the member's check at its end can tell
    said = list(warc.salvage(bytes(torn) + whole))
    assert set(ids(said)[:-6]) >= {0, 1} and len(ids(said)) >= 10 and gaps(said)


def test_maximal_segments_against_all_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(0, 14)).astype(float)

        def best(lo, hi):
            """Ruzzo and Tompa's definition: the best segment, and those left and right of it."""
            every = [(s[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not every or max(every)[0] <= 0:
                return []
            top = max(every)
            return [*best(lo, top[3]), (top[3], top[4], top[0]), *best(top[4], hi)]

        got, want = tox.maximal_segments(s), best(0, len(s))
        assert sum(x[2] for x in got) == sum(x[2] for x in want)
        assert max((x[2] for x in got), default=0) == max((x[2] for x in want), default=0)


def held_out_quality(rows, labels):
    got = tox.toxicity(rows, labels).where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    count = Counter({(r.predicted, r.toxic): r["count"] for r in got})
    recall, precision = count[1, 1] / max(1, count[1, 1] + count[0, 1]), count[1, 1] / max(1, count[1, 1] + count[1, 0])
    print("toxicity held out:", dict(count), "precision", precision, "recall", recall)
    return precision, recall


def test_toxicity_on_held_out_rows(spark, docs, nothing):
    sf = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    assert min(held_out_quality(rows, labels)) >= 0.85
    # each document eight times, and with that more labels than the sample takes
    eight = spark.range(8).select(F.col("id").alias("copy"))
    many = lambda df: df.crossJoin(eight).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 10_000_000).drop("copy")
    assert many(labels).where(~tox.held_out()).count() > tox.TRAIN_MOST
    assert min(held_out_quality(many(rows), many(labels))) >= 0.85
    # labels that a word tells without error
    clear = labels.withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    marked = rows.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("zorbag quuxly blathet "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    assert min(held_out_quality(marked, clear)) >= 0.95
    few = spark.createDataFrame([(6, 1), (12, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    assert tox.toxicity(docs, few).count() == len(TEXTS)
    assert {r.score for r in tox.toxicity(docs, few.limit(0)).collect()} == {0.5}
    assert tox.toxicity(nothing, few).count() == 0


def test_sharding(spark, docs, nothing):
    rows = shard_uniformly(docs, shards=3, rows_a_group=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert shard_uniformly(nothing).count() == 0
    matrix = communication_matrix([5, 0, 7, 4], [6, 5, 5], 1)
    assert [sum(x) for x in matrix] == [5, 0, 7, 4] and [sum(x) for x in zip(*matrix, strict=True)] == [6, 5, 5]
    again = shard_uniformly(docs.repartition(5), shards=3, rows_a_group=4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_logistic_curve_settles_on_separable_and_one_sided_labels():
    x = np.concatenate([np.zeros((5000, 2)), np.full((500, 2), 3.0)])
    y = np.concatenate([np.zeros(5000), np.ones(500)])
    a, b, c = tox.logistic(x, y)
    p = lambda v: 1 / (1 + np.exp(-(a + (b + c) * v)))
    assert p(0.0) < 0.05 and p(3.0) > 0.9 and b >= 0 and c >= 0
    for one in (0.0, 1.0):
        a, b, c = tox.logistic(x, np.full(len(x), one))
        assert np.isfinite([a, b, c]).all() and abs(1 / (1 + np.exp(-a)) - one) < 0.01
    a, b, c = tox.logistic(np.column_stack([x[:, 0], -x[:, 0] / 2]), y)  # a second column that falls
    assert c == 0 and b > 0


def test_null_ids_and_repeated_rows(spark):
    window = " ".join(f"w{i}" for i in range(20, 34))
    rows = [(None, BASE), (None, "other text"), (1, BASE), (1, BASE), (2, None), (3, ""), (1, BASE.replace("w30", "zz")), (None, window + " tail"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for run in (roundtrip_digests, ngram_jaccard_join, exact_dedup, tok.token_files_digest, shard_uniformly):
        assert run(docs).count() == len(rows), run
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    want = [(None, 1, 3, False), (None, None, 1, True), (1, 1, 3, True), (1, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False), (1, 1, 1, True), (None, None, 1, True), (4, 4, 1, True)]
    assert got == Counter(want)
    order = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    once = [(None, "other text"), (1, BASE), (2, None), (1, BASE.replace("w30", "zz")), (None, window + " tail"), (4, "a b")]
    assert order(without_copies(docs)) == sorted(once, key=repr)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect())
    assert got == Counter([(None, 56, 1), (None, 1, None), (1, 56, 1), (1, 56, 1), (2, 0, 2), (3, 0, 3), (1, 56, 1), (None, 11, None), (4, 1, 4)])
    near = without_near_copies(docs).collect()
    assert sorted((r.doc_id for r in near), key=repr) == sorted([1, None, 2, 3, None, 4], key=repr)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, items).collect())
    assert got == Counter([(None, 60, 24, True), (1, 60, 24, True), (1, 60, 24, True), (1, 60, 20, True), (None, 15, 14, True), (None, 2, 0, False), (2, 0, 0, False), (3, 0, 0, False), (4, 2, 0, False)])
    assert order(without_contaminated(docs, items)) == sorted([(None, "other text"), (2, None), (3, ""), (4, "a b")], key=repr)
    named = spark.createDataFrame([(None, "Released under the MIT License."), (7, "Released under the MIT License."), (7, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.license) for r in license_scan(named).collect()), key=repr) == [(7, "MIT notice"), (None, "MIT notice")]


def test_links_through_a_text_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    rows = [(5, edit(10)), (None, " ".join(words)), (9, edit(40)), (None, "no other text is like this one at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard_join(docs).collect()} == {(5, 5), (None, 5), (9, 5), (None, None)}
    assert {r.text for r in without_near_copies(docs).collect()} == {rows[0][1], rows[3][1]}
    assert [r.component_id for r in ngram_jaccard_join(docs.where("doc_id is null")).collect()] == [None, None]


def test_decontamination_in_blocks_of_tokens(spark, docs, monkeypatch):
    items = spark.createDataFrame([*ITEMS, (4, "one two"), (5, "one")], "item_id long, text string")
    want = collected(decontaminate(docs, items), "doc_id")
    monkeypatch.setattr(decontamination, "BLOCK_RUNS", 7)
    assert collected(decontaminate(docs, items), "doc_id") == want
    assert (want[4].n_hit, want[4].n_items) == (3, 3) and (want[3].n_hit, want[3].n_items) == (1, 1)


def test_url_filter_on_held_out_names():
    rows = labelled_urls()
    part = np.random.default_rng(1).permutation(len(rows)) % 4
    held = [r for r, k in zip(rows, part, strict=True) if k == 0]
    w = train([r for r, k in zip(rows, part, strict=True) if k])
    said = block_scores(w, [h for h, *_ in held], [p for _, p, _ in held]) >= 0.5
    assert np.mean(said == np.array([y for *_, y in held])) >= 0.95
    w = train(rows)
    assert (block_scores(w, ["smiths-plumbing.co.uk", "", "x"], ["/contact", "", ""]) < 0.5).all()  # what the table does not know is allowed
    one = [float(block_scores(w, [h], [p])[0]) for h, p, _ in rows[:50]]
    assert np.allclose(one, block_scores(w, [h for h, *_ in rows[:50]], [p for _, p, _ in rows[:50]]))


def test_license_recall_of_edited_copies(spark):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for k, (name, text) in enumerate((n, t) for n, t in sorted(templates().items()) if len(t.split()) > 60):
        words = text.split()
        for j in range(3):
            own = list(words)
            for at in rng.choice(len(own), max(1, len(own) // 60), replace=False):  # an edit each 60 words takes up to 5 shingles in 60
                own[at] = "changed"
            rows.append((10 * k + j, "some text before " + " ".join(own) + " and after"))
            want.add((10 * k + j, name))
    got = {(r.doc_id, r.license) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 20


def test_bpe_of_long_unsplit_texts(spark, library):
    rng = np.random.default_rng(8)
    letters = list("abcdeé字 ")[:-1]
    long = "".join(rng.choice(letters, 120_000))
    texts = [long, long[:50_000] + "\u3000" + long[50_000:], "<|endoftext|>" + long + "<|endoftext|>x", "x<|endoftext|><|endoftext|>", "\u00a0 y"]
    got = collected(encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id")
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode(text, add_special_tokens=False).ids


def test_shards_are_uniform(spark):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(4)
    seen, slots = np.zeros((600, 3)), np.zeros((3, 10))
    for seed in range(40):
        for r in shard_uniformly(rows, shards=3, seed=seed, rows_a_group=50).collect():
            seen[r.doc_id, r.shard] += 1
            if r.doc_id < 100:
                slots[r.shard, r.slot // 20] += 1
    expected = 40 / 3
    assert ((seen - expected) ** 2 / expected).sum() < 1200 + 5 * np.sqrt(2 * 1200)  # chi-square with 600 * 2 degrees of freedom
    assert ((slots - slots.mean()) ** 2 / slots.mean()).sum() < 29 + 5 * np.sqrt(2 * 29)


def test_hypergeometric_above_the_library_limit():
    from tessera.llm.sharding import hypergeometric

    rng = np.random.default_rng(2)
    draws = [hypergeometric(rng, 600_000_000, 900_000_000, 1000) for _ in range(2000)]
    assert abs(np.mean(draws) - 400) < 5 * np.sqrt(240 / 2000) and abs(np.var(draws) / 240 - 1) < 0.2


def test_stages_keep_columns_of_any_name(spark, docs):
    wide = docs.withColumns({"toxicity": F.lit("x"), "toxicity score": F.lit(1), "chunk": F.lit("y"), "row": F.lit(2), "TOKEN": F.lit(3), "pos": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        assert out.count() > 0, name
        assert name == "bpe" or out.columns == wide.columns, name
        assert stage(spark, wide.limit(0), SF).count() == 0, name


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    documents, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {tuple(w[k : k + 10]) for i in items if (w := split(i.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in windows}
    docs, ids = documents, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = docs.orderBy("doc_id").collect()
        kept = set(ids(out))
        assert len(kept) == out.count() >= 0.7 * len(before), name
        assert {(r.doc_id, r.text, r.source) for r in out.collect()} <= {(r.doc_id, r.text, r.source) for r in before}
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert ids(tox.toxicity(docs, labels).where("predicted = 0")) == sorted(kept)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
            assert kept == {min(own)[1] for own in best.values()}
        elif name == "ngram_jaccard":
            least = jaccard_classes([r.text for r in before])[1]
            assert kept == {before[i].doc_id for i in set(least)}
        else:
            hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
            assert kept == {r.doc_id for r in before if not hit(split(r.text))}
        docs = out
    final = corpus_pipeline.run(spark, sf)
    assert ids(final) == ids(docs) and final.columns[:2] == ["doc_id", "n_tokens"]
