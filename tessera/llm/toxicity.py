"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get log-odds between toxic and clean documents under a Dirichlet prior in proportion to their share of
both; those that stand clear of zero make the model. A linear scan over a text finds all of its maximal
segments: the passages whose sum of log-odds, less a drift for each word, no extension or cut improves.
The best segment of a text of n words by chance exceeds x with probability 1 - exp(-K n exp(-lambda x)), the
extreme-value law with lambda and K from clean texts; a logistic curve on the passages' corrected scores gives
the score of the text. Law and curve are fitted on texts that the odds in use did not see (four folds).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.workspace import written

from .textkit import U64, blocks, byte_values, folded, span_hashes, spans, window_hashes

TRAIN_MOST = 20_000  # labelled documents that the model is fitted on: a bounded sample, by a hash of the id
PRIOR = 200.0  # weight of the part of the Dirichlet prior that follows a token's share of all
FLAT = 0.5  # and its part that is the same for every token
CLEAR = 3.5  # standard errors from zero that a kept token's log-odds stand
DRIFT = 0.5  # of the sum for each word, so that passages end
STEMS = (0, 6, 8)  # a word's tokens: itself, and its first bytes (for languages that compound)
FOLDS = 4  # of the labelled sample: passages of each are found with the odds of the others
FOLD_RUN = 5  # words of the runs by which near copies come into one fold
RIDGE = 1e-3  # of the curve's penalty for each row
THRESHOLD = 0.3
ALPHA = 0.01  # a segment is significant if chance gives one as good in fewer than this share of clean texts

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_VALUES = byte_values(1)[folded()]


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of token, the hashes of all words of the block; and the index of each text's first word."""
    starts, ends, first = spans(data, offsets, _WORD)
    kinds = []
    for k, stem in enumerate(STEMS):
        stops = np.minimum(ends, starts + stem) if stem else ends
        kinds.append(span_hashes(data, starts, stops, _VALUES) ^ U64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    return kinds, first


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    odds: np.ndarray
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def word_scores(self, kinds: list[np.ndarray]) -> np.ndarray:
        """The log-odds of each word: that of its token furthest from zero, less the drift."""
        best = np.zeros(len(kinds[0]))
        if len(self.tokens):
            for hashes in kinds:
                at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
                odds = np.where(self.tokens[at] == hashes, self.odds[at], 0.0)
                best = np.where(np.abs(odds) > np.abs(best), odds, best)
        return best - DRIFT

    def features(self, segments: list[tuple[int, int, float]], n_words: int) -> tuple[float, float]:
        """Logarithms of the corrected score of the best segment and of the sum of all significant ones."""
        if not segments or not n_words:
            return 0.0, 0.0
        scores = np.array([s for *_, s in segments]) * self.rate - np.log(max(self.scale * n_words, 1e-12))
        return float(np.log1p(max(0.0, scores.max()))), float(np.log1p(scores[scores > -np.log(ALPHA)].sum()))

    def score(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        a, b, c = self.weights
        x, y = self.features(segments, n_words)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum), in order, by the linear-time scan of Ruzzo and Tompa."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # begin, end, sum before, sum after, the nearest earlier segment with a lower sum before
    for at in positive.tolist():
        begin, end, low, high = at, at + 1, sums[at], sums[at + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([begin, end, low, high, j])
                break
            begin, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, h - lo) for b, e, lo, h, _ in stack]


def labelled_texts(docs: DataFrame, labels: DataFrame, train_most: int) -> DataFrame:
    """(text, toxic, fold): the sample of labelled documents, texts of equal words once.

    A text's fold follows the least hash of its five-word runs, so most near copies share one. Equal texts of
    both labels count as toxic.
    """
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))  # at most train_most rows of two numbers

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                (words, *_), first = word_tokens(data, offsets)
                runs = window_hashes(words, FOLD_RUN)
                keys, folds = [], []
                for i in range(len(part)):
                    own = words[first[i] : first[i + 1]]
                    whole = runs[first[i] : max(first[i], first[i + 1] - FOLD_RUN + 1)]
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    folds.append(int((whole if len(whole) else own).min() >> U64(7)) % FOLDS if len(own) else 0)
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(folds, pa.int32()), pa.array(keys, pa.binary())], names=["text", "toxic", "fold", "key"])

    told = rows.mapInArrow(digest, "text string, toxic int, fold int, key binary")
    return told.groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.min("fold").alias("fold")).drop("key")


def _token_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic0, clean0, toxic1, clean1): in how many documents of either label of each fold each token occurs."""
    sides = [f"{label}{fold}" for fold in range(FOLDS) for label in ("clean", "toxic")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                kinds, first = word_tokens(data, offsets)
                held: list[list] = [[] for _ in sides]
                for i, (toxic, fold) in enumerate(zip(rows.column("toxic").to_pylist(), rows.column("fold").to_pylist(), strict=True)):
                    held[2 * fold + toxic].append(np.unique(np.concatenate([h[first[i] : first[i + 1]] for h in kinds])))
                for side, own in enumerate(held):
                    if own:
                        tokens, n = np.unique(np.concatenate(own), return_counts=True)
                        zero = pa.array(np.zeros(len(n), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), *(pa.array(n.astype(np.int64)) if k == side else zero for k in range(len(sides)))], names=["token", *sides])

    counted = labelled.mapInArrow(count, "token long, " + ", ".join(f"{c} long" for c in sides))
    return counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in sides))


def log_odds(counts: DataFrame, toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> tuple[Column, Column]:
    """(odds, z): log-odds with a Dirichlet prior in proportion to the token's overall share, and odds over their standard error."""
    prior = (toxic + clean) * (PRIOR / max(n_toxic + n_clean, 1.0)) + FLAT
    side = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y - prior))
    odds = side(toxic, n_toxic) - side(clean, n_clean)
    return odds, odds / F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def _models(counts: DataFrame) -> list[Model]:
    """For each fold the model of all other folds, and last that of all. They hold the tokens that stand clear of zero, which the labelled sample bounds."""
    sums = counts.agg(*(F.sum(c).alias(c) for c in counts.columns[1:])).first().asDict()
    fits = []
    for unseen in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != unseen]
        total = lambda label, folds=folds: sum((F.col(f"{label}{k}") for k in folds), F.lit(0))
        n = {label: float(sum(sums[f"{label}{k}"] or 0 for k in folds)) for label in ("toxic", "clean")}
        odds, z = log_odds(counts, total("toxic"), total("clean"), n["toxic"], n["clean"])
        fits.append(F.when(F.abs(z) >= CLEAR, odds).alias(f"odds{len(fits)}"))
    names = [f"odds{k}" for k in range(len(fits))]
    found = counts.select("token", *fits).where(F.coalesce(*names).isNotNull()).toPandas()
    models = []
    for name in names:
        own = found[found[name].notna()]
        tokens = own["token"].to_numpy(dtype=np.int64).astype(U64)
        order = np.argsort(tokens)
        models.append(Model(tokens[order], own[name].to_numpy(dtype=float)[order]))
    return models


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[float, ...]:
    """Weights (intercept first) of a logistic curve, none of a column below zero.

    Columns are standardised; the penalty, ``ridge`` for each row, pulls towards the curve that knows the base rate
    alone, so separable or one-sided labels have finite weights too. Newton steps are halved until the penalised
    likelihood rises; a fit that does not settle raises. A column whose weight would be negative is left out.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread < 1e-9, 1.0, spread)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    share = (y.sum() + 0.5) / (len(y) + 1)
    pull = ridge * len(y)

    def settled(z: np.ndarray) -> np.ndarray:
        centre = np.zeros(z.shape[1])
        centre[0] = np.log(share / (1 - share))
        loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + pull / 2 * ((w - centre) ** 2).sum()
        w, now = centre.copy(), loss(centre)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            slope = z.T @ (p - y) + pull * (w - centre)
            if np.abs(slope).max() <= 1e-6 * len(y):
                return w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(w)), slope)
            size = 1.0
            while loss(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-9:
                size /= 2
            w = w - size * step
            now = loss(w)
        raise RuntimeError("the curve of toxicity scores did not settle")

    used = list(range(z.shape[1]))
    w = settled(z)
    while (w[1:] < 0).any():
        used.pop(1 + int(np.argmin(w[1:])))
        w = settled(z[:, used])
    full = np.zeros(z.shape[1])
    full[used] = w
    full[1:] /= spread
    full[0] -= full[1:] @ mean
    return tuple(float(v) for v in full)


def karlin_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with mean of exp(lambda s) equal to 1; a mean below zero and a positive s are needed, else 1."""
    weights = weights / max(weights.sum(), 1)
    if not len(values) or values.max() <= 0 or (values * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (weights * np.exp(high * values)).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, train_most: int = TRAIN_MOST) -> Model:
    """A model from at most ``train_most`` labelled documents: (doc_id, text) and (doc_id, toxic). Rows without a label are left out.

    The extreme-value law and the curve are fitted on the passages that each fold's texts have under the odds of the other
    folds, which did not see them; the model's own odds are those of all.
    """
    rows = written(labelled_texts(docs, labels, train_most), "labelled")
    *apart, model = _models(written(_token_counts(rows), "token_counts"))
    shared = docs.sparkSession.sparkContext.broadcast(apart)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                kinds, first = word_tokens(data, offsets)
                scores = [own.word_scores(kinds) for own in shared.value]
                sums, steps, counts = [], [], []
                for i, fold in enumerate(part.column("fold").to_pylist()):
                    own = scores[fold][first[i] : first[i + 1]]
                    sums.append([s for *_, s in maximal_segments(own)])
                    values, n = np.unique(np.round(own, 2), return_counts=True)
                    steps.append(values)
                    counts.append(n)
                columns = [part.column("toxic"), part.column("fold"), pa.array(np.diff(first), pa.int64()), *(pa.array(c, pa.list_(t)) for c, t in ((sums, pa.float64()), (steps, pa.float64()), (counts, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "fold", "n", "sums", "steps", "counts"])

    seen = written(rows.mapInArrow(segments, "toxic int, fold int, n long, sums array<double>, steps array<double>, counts array<long>"), "segments")
    clean = seen.where("toxic = 0")
    steps = clean.select("fold", F.explode(F.arrays_zip("steps", "counts")).alias("x")).groupBy("fold", "x.steps").agg(F.sum("x.counts").alias("n")).orderBy("fold", "steps").toPandas()
    best = clean.select("fold", "n", F.coalesce(F.array_max("sums"), F.lit(0.0)).alias("best")).toPandas()  # at most train_most rows
    for fold, own in enumerate(apart):
        step, top = steps[steps["fold"] == fold], best[best["fold"] == fold]
        own.rate = karlin_rate(step["steps"].to_numpy(dtype=float), step["n"].to_numpy(dtype=float))
        if len(top):
            own.scale = float(len(top) / max(np.sort(top["n"] * np.exp(-own.rate * top["best"])).sum(), 1e-9))
    model.rate, model.scale = (float(np.exp(np.mean(np.log(v)))) for v in ([m.rate for m in apart], [m.scale for m in apart]))

    of_fold = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("fold") + 1)
    chance = F.log(F.greatest(of_fold([m.scale for m in apart]) * F.col("n"), F.lit(1e-12)))
    corrected = seen.select("toxic", F.transform("sums", lambda s: s * of_fold([m.rate for m in apart]) - chance).alias("s"))
    significant = F.aggregate(F.filter("s", lambda v: v > float(-np.log(ALPHA))), F.lit(0.0), lambda total, v: total + v)
    found = corrected.select("toxic", F.log1p(F.greatest(F.lit(0.0), F.array_max("s"))).alias("x"), F.log1p(significant).alias("y")).toPandas()
    if len(found):
        found = found.sort_values(["x", "y", "toxic"])  # sums of floats in one order, whatever the partitions
        model.weights = logistic(found[["x", "y"]].to_numpy(dtype=float), found["toxic"].to_numpy(dtype=float))
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column of scores, 0 to 1; a null or empty text has the score of no passage. All columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                kinds, first = word_tokens(data, offsets)
                scores = shared.value.word_scores(kinds)
                values = [shared.value.score(maximal_segments(scores[first[i] : first[i + 1]]), int(first[i + 1] - first[i])) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, DoubleType()))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, begin, end, sum, p_value) of every significant passage; begin and end count words, p_value is for one as good by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                kinds, first = word_tokens(data, offsets)
                own, scores, ids, rows = shared.value, shared.value.word_scores(kinds), part.column("id"), []
                for i in range(len(part)):
                    n = int(first[i + 1] - first[i])
                    for b, e, s in maximal_segments(scores[first[i] : first[i + 1]]):
                        p = -np.expm1(-own.scale * n * np.exp(-own.rate * s))
                        if p < ALPHA:
                            rows.append((ids[i].as_py(), b, e, s, float(p)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=[id_col, "begin", "end", "sum", "p_value"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, `begin` long, `end` long, `sum` double, p_value double")


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted), learnt from the labels that are not held out.

    Only the text enters a score. Null and empty texts get the score of a text without a passage. Repeated rows
    each give a row. Without labels the score is 0.5 for all. An empty table gives an empty table.
    """
    model = fit(docs, labels.where(~held_out()))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
