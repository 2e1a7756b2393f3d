"""URL filter: rules by host and path, and for all other urls a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U64, mix

#: The rules of the query, as (verdict, host and all its subdomains, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BITS = 14
GRAMS = (3, 4, 5)
BAD_SHARE = 0.2
#: The labelled table is made of these by ``labelled_urls``: subjects of sites to block and to allow, words that stand beside them, ends of hosts.
BAD_SUBJECTS = (
    "casino", "slots", "poker", "roulette", "betting", "lottery", "jackpot", "viagra", "cialis", "pharmacy-no-rx", "cheap-pills", "weight-loss-pills", "payday-loan", "fast-loans", "debt-relief",
    "porn", "xxx", "adult-cams", "escorts", "hookup", "malware", "phishing", "keygen", "crack", "warez", "torrent", "serial-key", "free-money", "make-money-fast", "get-rich", "spam", "link-farm",
    "seo-backlinks", "click-bait", "replica-watches", "fake-rolex", "prize-winner", "gift-card-generator", "crypto-doubler", "miracle-cure",
)
GOOD_SUBJECTS = (
    "news", "weather", "library", "museum", "university", "school", "college", "science", "physics", "biology", "history", "geography", "music", "theatre", "cinema", "recipes", "garden", "travel",
    "hotel", "railway", "airport", "football", "cycling", "health", "hospital", "dentist", "parliament", "city-council", "tax-office", "court", "books", "poetry", "journal", "archive", "wiki", "docs",
    "manual", "developer", "software", "statistics", "economy", "bank", "insurance", "bakery", "furniture", "photography", "painting", "architecture", "astronomy", "volunteers",
)
BAD_BESIDE = ("best", "top", "free", "cheap", "win", "bonus", "hot", "now", "deals", "online", "4u", "777")
GOOD_BESIDE = ("the", "my", "national", "open", "old", "local", "online", "group", "guide", "house", "world", "free")
TAILS = ("com", "net", "org", "info", "co.uk", "de", "fr", "io")
PAGES = ("", "/", "/index.html", "/about-us", "/2021/05/some-title", "/p/123456", "/search", "/blog/how-it-began.html", "/category/new/page/2")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): a table of about 2,000 urls, each subject with each word beside it, before or after, in the host or in the path."""
    rows = []
    for label, subjects, beside in ((1, BAD_SUBJECTS, BAD_BESIDE), (0, GOOD_SUBJECTS, GOOD_BESIDE)):
        for i, subject in enumerate(subjects):
            for j, word in enumerate(beside):
                name = (f"{subject}-{word}", f"{word}{subject}", f"{subject}{word}", f"www.{subject}", subject)[(i + j) % 5]
                tail, page = TAILS[(3 * i + j) % len(TAILS)], PAGES[(i + 2 * j) % len(PAGES)]
                rows.append((f"{name}.{tail}", page, label))
                neutral = GOOD_SUBJECTS[(7 * i + j) % len(GOOD_SUBJECTS)]
                rows.append((f"{neutral}.{tail}", f"/{word}/{subject}{page}" if label else f"/{subject}{page}", label))
    return rows


def gram_ids(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the character n-grams of hosts and paths, each bucket once a row; the two parts are told apart. All rows at once."""
    keys = []
    for part, texts in ((1, hosts), (2, paths)):
        codes = np.frombuffer("".join(f"^{t}$" for t in texts).encode("utf-32-le"), dtype="<u4").astype(U64)
        sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
        row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        for n in (n for n in GRAMS if n <= len(codes)):
            h = np.full(len(codes) - n + 1, part * 16 + n, dtype=U64)
            for j in range(n):
                h = h * U64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
            inside = left[: len(h)] >= n
            keys.append((row[: len(h)][inside] << BITS) | (mix(h[inside]) >> U64(64 - BITS)).astype(np.int64))
    every = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *keys]))
    return every >> BITS, every & ((1 << BITS) - 1)


def block_scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability to block of each url; a row's vector has length 1."""
    row, bucket = gram_ids(hosts, paths)
    size = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], minlength=len(hosts)) / np.sqrt(size) + weights[-1])))


def train(rows: list[tuple[str, str, int]], rounds: int = 300, ridge: float = 3e-5) -> np.ndarray:
    """Weights of 2**BITS buckets and an intercept, by full-batch gradient steps on the small table; each row's vector has length 1.

    Rows to block weigh ``BAD_SHARE`` together, as sites to block are rare: what the table does not know is allowed.
    """
    row, bucket = gram_ids([h for h, *_ in rows], [p for _, p, _ in rows])
    y = np.array([label for *_, label in rows], dtype=float)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))[row]
    weigh = np.where(y > 0, BAD_SHARE / max(1.0, y.sum()), (1 - BAD_SHARE) / max(1.0, (1 - y).sum()))
    w = np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[bucket], minlength=len(rows)) + w[-1])))
        miss = (y - p) * weigh
        w[:-1] += 60.0 * (np.bincount(bucket, value * miss[row], minlength=1 << BITS) - ridge * w[:-1])
        w[-1] += miss.sum()
    return w


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; an equal length falls to the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule = F.when(fits, own + prefix).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, labelled: list[tuple[str, str, int]] | None = None, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, score).

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there
    to ``?``, ``#`` or the end. Without ``://``, and for null, both are empty. A null page_id stays null. The longest fitting rule
    decides; where none fits the regression does (score: its probability to block). Repeated rows each give a
    row; an empty table gives an empty table. Other columns are not read.
    """
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled if labelled is not None else labelled_urls()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            scores = block_scores(w, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = parts.mapInArrow(run, f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
