"""Phrase collocation mining with word-id suffix arrays.

1. Texts are cut into shards of one language: an array of word numbers with a break between pieces, and the words that the
   numbers stand for. Counts of words are merged over all shards.
2. A shard's suffixes are sorted by prefix doubling; neighbours that share their first words (the intervals of the array of common
   prefixes) are the occurrences of one n-gram. Counts of word pairs are merged by key.
3. Only frequent pairs can be part of a frequent longer phrase: shards break at all others, and what is left of them, the runs of
   three and more words, is gathered by language into fewer shards.
4. Counts of the longer n-grams of these are first summed in hashed buckets. Only n-grams whose bucket holds enough are spelt out and
   merged as the pairs are: a bucket holds all occurrences of its n-grams, so no frequent one is left out, and of the rare ones few are made.

Keys are the words themselves. Shards know the frequent pairs by a broadcast array of 64-bit hashes of at most ``KNOWN_MOST`` (two pairs of one
hash only mean a break less). Where there are more, each shard is told by a join which of its own pairs are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import partitions, written

from .textkit import U64, blocks, folded, mix, span_hashes, spans

BREAK = np.zeros(256, dtype=bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
WORD = ~BREAK
WORD[[32, 9]] = False
SHARD_WORDS = 2 << 20
HELD_WORDS = 4 << 20  # of all languages that a task gathers at once
ROWS = 1 << 14
PART_WORDS = 1 << 18  # of which pairs are looked up at once
KNOWN_MOST = 8 << 20  # hashes that are broadcast: 64 MB
GROUP_WORDS = 8 << 20  # of a language's shards whose runs are gathered together
BUCKETS = (20, 28)  # bits of the number of buckets, at least and at most: 32 MB are broadcast; more n-grams only share more buckets
PART_BITS = 18  # of the buckets that are summed together
SALTS = 16
NO_LANG = "und"
SHARDS = "shard long, lang string, n long, ids binary, words array<string>, counts array<long>"


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a block, whether each begins a piece, and the number of the text that it is of."""
    starts, ends, first = spans(data, offsets, WORD)
    taken = WORD[data]
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(folded()[data[taken]])])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
    begins = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        begins[1:] = (breaks[starts[1:]] != breaks[ends[:-1]]) | (text[1:] != text[:-1])
    return words, begins, text


def _packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    task, made = TaskContext.get().partitionId(), 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal made
        parts = held.pop(lang)
        del sizes[lang]
        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        begins = np.flatnonzero(np.concatenate([p[1] for p in parts]))
        own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.insert(own + 1, begins, 0)
        made += 1
        return pa.RecordBatch.from_arrays([
            pa.array([task << 32 | made], pa.int64()), pa.array([lang]), pa.array([len(own)], pa.int64()), pa.array([_packed(ids)], pa.binary()),
            pa.array([coded.dictionary.cast(pa.binary()).cast(pa.string())], pa.list_(pa.string())), pa.array([np.bincount(own)], pa.list_(pa.int64())),
        ], names=["shard", "lang", "n", "ids", "words", "counts"])

    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            words, begins, text = _block_words(data, offsets)
            if not len(words):
                continue
            langs = part.column("lang").dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)[text]
            for k in np.unique(of):
                lang, own = langs.dictionary[int(k)].as_py(), np.flatnonzero(of == k)
                held.setdefault(lang, []).append((words.take(pa.array(own)), begins[own]))
                sizes[lang] = sizes.get(lang, 0) + len(own)
                if sizes[lang] >= SHARD_WORDS:
                    yield flush(lang)
            while sum(sizes.values()) >= HELD_WORDS:
                yield flush(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield flush(lang)


def room(ids: np.ndarray) -> np.ndarray:
    """From each place, the words up to the next break (0)."""
    ends = np.append(np.flatnonzero(ids == 0), len(ids)).astype(np.int32)
    sizes = np.diff(ends, prepend=np.int32(-1))
    sizes[-1] -= 1  # the end is no place
    return np.repeat(ends, sizes) - np.arange(len(ids), dtype=np.int32)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the different ones, as ``np.unique`` gives it, in less memory."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), dtype=bool)
    if len(keys):
        np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    ranks = np.empty(len(keys), dtype=np.int32)
    ranks[order] = np.cumsum(new, dtype=np.int32)
    return ranks


def suffix_array(ids: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places with at least ``least`` words before the next break, in the order of their first ``most`` words; words that each shares with the one before, ``most`` at most).

    Prefix doubling: the rank of the first 2h words comes from the ranks of the h words here and of the h words after them. A shard is short enough for 32 bits.
    """
    ids = ids.astype(np.int32, copy=False)
    left = room(ids)
    rank, h = ids, 1
    while h < most:
        step = min(h, most - h)  # the last step may overlap the words before it
        keys = rank * np.int64(int(rank.max(initial=0)) + 1)
        keys[:-step] += np.where(left[:-step] < step, 0, rank[step:])
        rank = _ranks(keys)
        del keys
        h += step
    at = np.flatnonzero(left >= least).astype(np.int32)
    order = at[np.argsort(rank[at], kind="stable")]
    del at, rank
    shared = np.zeros(len(order), dtype=np.int8 if most < 128 else np.int32)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for j in range(most):
        word = np.where(left[order] > j, ids[np.minimum(order + np.int32(j), np.int32(len(ids) - 1))], 0)
        same &= (word[1:] == word[:-1]) & (word[1:] > 0)
        shared[1:] += same
    return order, shared


def ngram_counts(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, one place of each n-gram, its count) for each length from ``least`` to ``most``: the intervals of the common prefixes."""
    order, shared = suffix_array(ids, least, most)
    left = room(ids)[order]
    for length in range(least, most + 1):
        first = np.flatnonzero(shared < length)
        counts = np.diff(np.append(first, len(order)))
        whole = left[first] >= length
        yield length, order[first[whole]], counts[whole]


def _word_hashes(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return span_hashes(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), ends[:-1], ends[1:])


def _pair_hashes(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(lang * U64(0x9FB21C651E98DF25) + first * U64(0x589965CC75374CC3) + second * U64(0x2545F4914F6CDD1D))


def _phrase_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of pairs (lang, phrase)."""
    for batch in batches:
        words = _word_hashes(pc.split_pattern(batch.column("phrase"), " ").values)
        own = _pair_hashes(_word_hashes(batch.column("lang")), words[::2], words[1::2])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64))], names=["h"])


def _broken(ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """``ids`` with a break between neighbours whose pair is not good."""
    return np.insert(ids, np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & ~good) + 1, 0)


def _known_by_hash(lang: str, ids: np.ndarray, words: pa.Array, known: np.ndarray) -> np.ndarray:
    table, of = np.append(U64(0), _word_hashes(words)), _word_hashes(pa.array([lang]))
    good = np.zeros(max(0, len(ids) - 1), dtype=bool)
    for k in range(0, len(good) if len(known) else 0, PART_WORDS):
        hashes = table[ids[k : k + PART_WORDS + 1]]
        own = _pair_hashes(of, hashes[:-1], hashes[1:]).astype(np.int64)
        good[k : k + PART_WORDS] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    return good


def _known_by_code(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(ids[:-1].astype(np.int64) << 32 | ids[1:], known)


GRAMS = "lang string, phrase string, length int, count long"
PLACED = f"{GRAMS}, shard long, code long"


def _rows(shard: int, lang: str, ids: np.ndarray, words: pa.Array, grams: Iterator[tuple[int, np.ndarray, np.ndarray]], placed: bool = False) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of a shard; ``placed`` adds the shard and the numbers of the first two words."""
    for length, places, counts in grams:
        for k in range(0, len(places), ROWS):
            at = places[k : k + ROWS]
            phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + j] - 1)) for j in range(length)], " ")
            each = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(at))  # noqa: B023, E731
            columns = {"lang": each(lang, pa.string()), "phrase": phrase, "length": each(length, pa.int32()), "count": pa.array(counts[k : k + ROWS])}
            if placed:
                columns |= {"shard": each(shard, pa.int64()), "code": pa.array(ids[at].astype(np.int64) << 32 | ids[at + 1])}
            yield pa.RecordBatch.from_pydict(columns)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, pa.Array, pa.Array | None]]:
    for batch in batches:
        known = batch.column("known") if "known" in batch.schema.names else None
        for i in range(batch.num_rows):
            shard, lang, ids = (batch.column(c)[i].as_py() for c in ("shard", "lang", "ids"))
            yield shard, lang, _unpacked(ids), batch.column("words")[i].values, None if known is None else known[i].values


def _pairs(batches: Iterator[pa.RecordBatch], placed: bool = False) -> Iterator[pa.RecordBatch]:
    for shard, lang, ids, words, _ in _each(batches):
        yield from _rows(shard, lang, ids, words, ngram_counts(ids, 2, 2), placed)


def _long_runs(ids: np.ndarray, words: pa.Array, least: int = 3) -> tuple[np.ndarray, pa.Array]:
    """The runs of at least ``least`` words, and the words in them."""
    sizes = np.diff(np.append(np.flatnonzero(ids == 0), len(ids)), prepend=-1)  # with the break after each
    kept = np.append(ids, 0)[np.repeat(sizes > least, sizes)]
    used = np.zeros(len(words) + 1, dtype=bool)
    used[kept] = True
    used[0] = False
    return np.cumsum(used, dtype=np.int32)[kept], words.filter(pa.array(used[1:]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of one language as one, up to ``SHARD_WORDS``."""
    held: dict[str, list[tuple[np.ndarray, pa.Array]]] = {}
    sizes: dict[str, int] = {}
    task, made = TaskContext.get().partitionId(), 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal made
        parts = held.pop(lang)
        del sizes[lang]
        coded = pa.concat_arrays([words for _, words in parts]).dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False) + np.int32(1)
        ends = np.cumsum([len(words) for _, words in parts])
        ids = np.concatenate([np.append(np.int32(0), numbers[end - len(words) : end])[own] for (own, words), end in zip(parts, ends, strict=True)])
        made += 1
        return _run_batch(task << 32 | made, lang, ids, coded.dictionary)

    for _, lang, ids, words, _ in _each(batches):
        if lang in held and sizes[lang] + len(ids) > SHARD_WORDS:
            yield flush(lang)
        held.setdefault(lang, []).append((ids, words))
        sizes[lang] = sizes.get(lang, 0) + len(ids)
        while sum(sizes.values()) >= HELD_WORDS:
            yield flush(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield flush(lang)


RUNS = "shard long, lang string, n long, ids binary, words array<string>"


def _run_batch(shard: int, lang: str, ids: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([len(ids)], pa.int64()), pa.array([_packed(ids)], pa.binary()), pa.array([words], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n", "ids", "words"])


def _runs(shards: DataFrame, two: DataFrame) -> DataFrame:
    """The runs of three and more words of the shards whose pairs are all frequent."""
    groups = shards.groupBy("lang").agg(F.ceil(F.sum("n") / GROUP_WORDS).alias("groups"))
    shards = shards.select("shard", "lang", "ids", "words")
    if two.count() <= KNOWN_MOST:
        hashes = two.select("lang", "phrase").mapInArrow(_phrase_hashes, "h long").toArrow().column("h")  # 8 bytes for each of KNOWN_MOST at most
        known = shards.sparkSession.sparkContext.broadcast(np.sort(hashes.to_numpy()))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, lang, ids, words, _ in _each(batches):
                yield _run_batch(shard, lang, *_long_runs(_broken(ids, _known_by_hash(lang, ids, words, known.value)), words))
    else:
        own = shards.mapInArrow(lambda b: _pairs(b, True), PLACED).join(two, ["lang", "phrase"], "left_semi").groupBy("shard").agg(F.collect_list("code").alias("known"))
        shards = shards.join(own, "shard")

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, lang, ids, words, codes in _each(batches):
                yield _run_batch(shard, lang, *_long_runs(_broken(ids, _known_by_code(ids, codes.to_numpy(zero_copy_only=False))), words))

    runs = shards.mapInArrow(told, RUNS).where("n > 0").join(F.broadcast(groups), "lang")
    return runs.repartition(partitions(runs.sparkSession), "lang", F.pmod(F.xxhash64("shard"), "groups")).drop("groups").mapInArrow(_gathered, RUNS)


def _buckets(lang: str, ids: np.ndarray, words: pa.Array, longest: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, counts, buckets) of the n-grams of three and more words of a shard."""
    table, of = np.append(U64(0), _word_hashes(words)), _word_hashes(pa.array([lang]))
    for length, places, counts in ngram_counts(ids, 3, longest):
        hashes = np.repeat(of, len(places))
        for j in range(length):
            hashes = mix(hashes * U64(0x9FB21C651E98DF25) + table[ids[places + j]])
        yield length, places, counts, (hashes >> U64(64 - bits)).astype(np.int64)


def _full(runs: DataFrame, least: int, longest: int, bits: int) -> np.ndarray:
    """A bit for each bucket: whether its n-grams occur ``least`` times together."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, ids, words, _ in _each(batches):
            found = [(buckets, counts) for _, _, counts, buckets in _buckets(lang, ids, words, longest, bits)]
            buckets, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(buckets)
            buckets = buckets[order]
            first = np.flatnonzero(np.diff(buckets, prepend=-1))
            counts = np.minimum(np.add.reduceat(counts[order], first), least) if len(first) else counts
            buckets = buckets[first]
            parts = buckets >> PART_BITS
            cuts = np.flatnonzero(np.diff(parts, prepend=-1))
            for k, end in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
                inside = buckets[k:end] & ((1 << PART_BITS) - 1)
                columns = [pa.array([parts[k]], pa.int64()), pa.array([_packed(np.diff(inside, prepend=0))], pa.binary()), pa.array([_packed(counts[k:end])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "steps", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, np.zeros(1 << PART_BITS, dtype=np.int64)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for i in range(batch.num_rows):
                own, steps, counts = (batch.column(c)[i].as_py() for c in ("part", "steps", "counts"))
                if own != part:
                    if part is not None:
                        yield flush()
                    part, sums[:] = own, 0
                sums[np.cumsum(_unpacked(steps))] += _unpacked(counts)
        if part is not None:
            yield flush()

    sums = runs.mapInArrow(tallied, "part long, steps binary, counts binary").repartition(partitions(runs.sparkSession), "part").sortWithinPartitions("part").mapInArrow(summed, "part long, bits binary")
    full = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << PART_BITS) // 8
    for part, own in sums.collect():  # a bit for each bucket at most
        full[part * size : (part + 1) * size] = np.frombuffer(own, dtype=np.uint8)
    return full


def _longer(shards: DataFrame, two: DataFrame, longest: int, least: int) -> DataFrame:
    """Counts of n-grams of three and more words by gathered shard: of all that occur ``least`` times in a language, and of rare ones that share a bucket's count."""
    runs = written(_runs(shards, two), "runs")
    words = runs.agg(F.sum("n")).first()[0] or 0
    bits = min(max(BUCKETS[0], (words // 2).bit_length()), BUCKETS[1])
    full = runs.sparkSession.sparkContext.broadcast(_full(runs, least, longest, bits))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lang, ids, words, _ in _each(batches):
            for length, places, counts, buckets in _buckets(lang, ids, words, longest, bits):
                held = (full.value[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8) & 1).astype(bool)
                yield from _rows(shard, lang, ids, words, [(length, places[held], counts[held])])

    return runs.mapInArrow(grams, GRAMS)


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases up to ``longest`` words with f >= ``least``, and (lang, n), the words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    shards = written(texts.mapInArrow(_cut, SHARDS), "shards")
    # counts of a shard are merged as they are: one map of all n-grams of a task's shards would be its largest need of memory
    merged = lambda local: local.repartition("lang", "phrase").groupBy("lang", "phrase", "length").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    own = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.lit(1).alias("length"), F.col("w.counts").alias("count"))
    found = [written(merged(own), "frequent")]
    if longest > 1:
        found.append(written(merged(shards.select("shard", "lang", "ids", "words").mapInArrow(_pairs, GRAMS)), "frequent"))
    if longest > 2:
        found.append(written(merged(_longer(shards, found[1], longest, least)), "frequent"))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    total = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    return every, written(total, "totals")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000, lang_col: str = "lang", text: str = "text") -> DataFrame:
    """The best collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts, A-Z lower-cased, are cut at ASCII sentence signs and line ends into pieces, these at spaces and tabs into words. A candidate is a phrase of 2 to
    ``longest`` words with a = f >= ``least`` occurrences in a language. Cut after k words into parts with l and r occurrences it scores
    floor(1000 a n / (l r)), n being all words of the language; its lowest cut counts, of equal ones the shortest first part. A candidate is left out
    if a longer one that contains it has at least ``covered`` hundredths of its occurrences. Of the rest each language gives its ``top`` by score, a (both
    descending) and phrase (by bytes); that limit is the report. A null language is ``und``, null texts have no words; ids are not
    read, so null and repeated ones, and rows that repeat, count like any other. An empty table gives an empty one.
    """
    every, totals = phrase_counts(docs, least, longest, lang_col, text)
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    candidates = every.where("length > 1")
    cuts = candidates.select("lang", "phrase", "length", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(every.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    cuts = cuts.join(totals, "lang").withColumns({"wide": F.lit(1000).cast("decimal(38,0)") * _wide("a") * _wide("n"), "by": _wide("l") * _wide("r")})
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(F.expr("wide div by").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    # a count can only fall as words are added, so a longer candidate that covers this one implies one with a single word more that does
    longer = candidates.where("length > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("length") - 1), part(F.lit(2), F.col("length") - 1))).alias("phrase"))
    scored = scored.join(longer.groupBy("lang", "phrase").agg(F.max("f").alias("most")), ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * covered, F.lit(True)))
    told = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # each part of a language gives its own best first
    best = told.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
