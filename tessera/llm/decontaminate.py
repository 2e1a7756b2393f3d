"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions alone.

Items are cut into windows of consecutive words; the tokens of a window are its short word shingles. A
window occurs only where all of its tokens do, so the necessary prefix is its one rarest token, by a count
over all documents. One pass over the documents finds the places of all tokens, by hash and then word by word; from these
come the counts, the prefixes and, as the token's place in the window bounds where the window may start and end, the
candidates. A candidate is verified by all tokens of its window at their places. Texts are not moved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import written

from .rows import TAGS, row_tags, rows_not_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = 5
BLOCK_RUNS = 1 << 18  # runs of words that are broadcast at once, some 40 MB in a task's table


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else: lower() where the text is ASCII, as translate() is the slower."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def token_of(words: Callable[[int], Column], width: int) -> Column:
    return F.xxhash64(*[words(j) for j in range(width)], F.lit(width))


def tokens_of(words: str, widths: list[int]) -> Column:
    """Hashes of all runs of as many words, of each width in turn; none of a width where there are fewer words."""

    def of(width: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: token_of(lambda j: F.get(F.col(words), i + j), width))
        return F.when(F.size(words) >= width, grams).otherwise(F.array().cast("array<long>"))

    return F.concat(*map(of, widths))


def numbered_runs(runs: DataFrame, widths: list[int]) -> DataFrame:
    """(run, token, number) of the distinct runs of words (run), a written table: the number is made once and stands for the words."""
    hashed = F.lit(None).cast("long")
    for k in widths:
        hashed = F.when(F.size("run") == k, token_of(lambda j: F.get(F.col("run"), F.lit(j)), k)).otherwise(hashed)
    return written(runs.select("run").distinct().select("run", hashed.alias("token"), F.monotonically_increasing_id().alias("number")), "wanted")


def met_runs(docs: DataFrame, keys: list[str], wanted: DataFrame, widths: list[int]) -> DataFrame:
    """(keys, n, pos, token, number) of every place of ``docs`` (keys, words) where one of the ``wanted`` runs (see ``numbered_runs``) stands.

    Found by hash; the words themselves are compared where a hash agrees, beside the text, so that only places move on. The runs go to all
    tasks in blocks of at most ``BLOCK_RUNS``: more of them mean more passes over the documents, not a shuffle of all of their words.
    """
    if not widths:
        return docs.select(*keys, F.size("words").alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("token"), F.lit(0).cast("long").alias("number")).limit(0)
    # explode of one element keeps the optimizer from splitting the text anew for each token
    told = docs.select(*keys, F.explode(F.array("words")).alias("words")).select(*keys, "words", F.size("words").alias("n"), tokens_of("words", widths).alias("tokens"))
    told = told.select(*keys, "n", "words", F.posexplode("tokens").alias("at", "token"))
    blocks = max(1, -(-wanted.count() // BLOCK_RUNS))
    parts = [told.join(F.broadcast(wanted.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == k) if blocks > 1 else wanted), "token") for k in range(blocks)]
    pos = F.col("at")
    for before, own in zip(widths, widths[1:], strict=False):  # places of one width follow those of the one before
        pos = F.when(F.size("run") >= own, pos - F.greatest(F.col("n") - before + 1, F.lit(0))).otherwise(pos)
    met = reduce(DataFrame.union, parts).withColumn("pos", pos)
    return met.where(F.slice("words", F.greatest(F.col("pos") + 1, F.lit(1)), F.size("run")) == F.col("run")).select(*keys, "n", "pos", "token", "number")


def item_windows(items: DataFrame, item_col: str, text: str, width: int) -> DataFrame:
    """(item, words): all runs of ``width`` words of an item, or the whole of a shorter one."""
    split = items.select(F.col(item_col).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    return split.select("item", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("at"), "w").select("item", F.slice("w", F.col("at"), width).alias("words"))


def contaminated_rows(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(TAGS, n_hit, n_items, items) of the rows with a hit, by their identity."""
    keys = list(TAGS)
    split = docs.select(*row_tags(id_col, text), words_of(F.col(text)).alias("words"))
    cut = item_windows(items, item_col, text, width)
    # windows are named by a number that is made once, in what is written
    named = written(cut.groupBy("words").agg(F.collect_set(F.col("item").cast("string")).alias("items")).withColumn("window", F.monotonically_increasing_id()), "windows")
    windows = named.select("window", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(TOKEN)).alias("k"))
    widths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # 1 to TOKEN
    starts = F.sequence(F.lit(0), F.col("size") - F.col("k"))
    cut = windows.select("window", "size", "k", F.explode(starts).alias("off"), "words").select("window", "size", "k", "off", F.slice("words", F.col("off") + 1, F.col("k")).alias("run"))
    wanted = numbered_runs(cut, widths)
    placed = written(cut.join(wanted, "run").select("window", "size", "k", "off", "number"), "placed")
    met = written(met_runs(split, keys, wanted, widths), "met")

    seen = met.groupBy("number").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("window").orderBy("df", "number", "off")
    # A window with a run that no document holds occurs nowhere: its rarest one has no count.
    counted = placed.join(seen, "number", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = written(counted.withColumn("r", F.row_number().over(rarest)).where("r = 1 and df > 0").select("window", "size", "off", "number"), "prefix")
    start = F.col("pos") - F.col("off")
    near = met.join(prefix, "number").where((start >= 0) & (start + F.col("size") <= F.col("n"))).select(*keys, start.alias("start"), "window").distinct()
    # a candidate holds if each run of its window stands at its place
    due = near.join(placed, "window").select(*keys, "start", "window", "size", "k", (F.col("start") + F.col("off")).alias("pos"), "number")
    held = due.join(met.select(*keys, "pos", "number").distinct(), [*keys, "pos", "number"])
    found = held.groupBy(*keys, "start", "window", "size", "k").agg(F.count("*").alias("runs")).where("runs = size - k + 1")
    hits = written(found.select(*keys, "start", "window", "size"), "hits")

    places = hits.select(*keys, "start", "size").distinct().select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p"))
    covered = places.distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    told = hits.select(*keys, "window").distinct().join(named.select("window", F.explode("items").alias("item")), "window").select(*keys, "item").distinct()
    listed = told.groupBy(*keys).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    return written(covered.join(listed, keys), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: (id_col, n_words, n_hit, n_items, items_sha256, contaminated).

    Words are the runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased. A word is hit if it
    lies in any occurrence of a window of an item; n_items counts the items with occurring windows, whose
    ids, sorted as strings and joined by commas, items_sha256 digests (of '' if none). Null and empty
    texts have no words; wordless items have no windows, items without an id none that count. Every row has the hits of
    its own text, whether its id is null or repeated. Either table may be empty. Other columns are not read.
    """
    found = contaminated_rows(docs, items, width, id_col, item_col, text)
    sizes = docs.select(F.col(id_col).alias("id"), *row_tags(id_col, text), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    out = sizes.join(found, list(TAGS), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """The rows without a hit, with all columns whatever their names; rows with a null id are judged by their text like any other."""
    return rows_not_of(docs, contaminated_rows(docs, items, width, id_col, item_col, text), id_col, text)
