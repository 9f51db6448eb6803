"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

A bounded, hash-chosen sample of labelled rows (MOST_TOXIC and MOST_CLEAN rows at most) is split in
three: one part yields the lexicon (words and word beginnings that toxic rows favour, by a smoothed
log-odds z-score), one grows the trees, and one fits the isotonic curve from tree margin to
probability.  A sampled row counts for as many training labels of its class as there are for each sampled
one, so scores keep the true share of toxic rows whatever the bounds.  Rows whose crc32(doc_id as text)
mod 5 is 0 are never looked at.  The lexicon has TERMS terms at most.  Every text is then scored whole, in one
pass over the documents.

Features of a text: lexicon densities (share of words, count, sum and largest weight), lexicon words
near a second-person word, capitals, punctuation, exclamation marks, obfuscated words (letters mixed
with digits or signs), and length.

Defined results: a null text counts as empty and gets the score of a text without words; labels that
are null take no part, repeated labels count once (the largest); labels without a document and documents
without an id are not learnt from; with no toxic or no clean label to learn from, every score is the share of
toxic labels (0 without any); repeated documents each get their score, equal texts the same one; an empty table
gives an empty result; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, slices, table

#: Bounds of the labelled sample; terms of the lexicon; documents of the toxic class that a term needs.
MOST_TOXIC, MOST_CLEAN, TERMS, SUPPORT = 8_000, 16_000, 1_000, 3
HELD_OUT_OF = 5
ROUNDS, DEPTH, RATE, RIDGE, BINS = 60, 3, 0.2, 1.0, 32
#: Distinct words that a task remembers before it starts afresh; bounds memory, not results.
MEMO = 100_000
#: Lengths of word beginnings that are terms besides whole words.
STEMS = (4, 5, 6)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
NEAR = 5
EDGES = ".,;:!?\"'()[]{}|…«»“”„¿¡-"
PLAIN = str.maketrans("013457@$", "oieastas")
FEATURES = ("words", "hits", "density", "weight", "largest", "mean", "near", "capitals", "punctuation", "exclaims", "obfuscated")


def terms(word: str) -> list[str]:
    """The word, its beginnings, and the same with common signs read as letters."""
    out = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]
    if not word.isalpha() and (plain := word.translate(PLAIN)) != word and plain.isalpha():
        out += [plain, *(plain[:n] + "*" for n in STEMS if len(plain) >= n)]
    return out


def obfuscated(word: str) -> bool:
    return len(word) > 2 and any(c.isalpha() for c in word) and not word.isalpha() and bool(re.fullmatch(r"\w*[^\W_][\d@$*!_]+[^\W\d_]\w*", word))


class Reader(dict):
    """Raw word -> (weight, second person, obfuscated)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> tuple[float, bool, bool]:
        if len(self) > MEMO:
            self.clear()
        word = raw.strip(EDGES)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0) if word else 0.0
        out = self[raw] = (weight, word in SECOND_PERSON, obfuscated(word))
        return out

    def features(self, text: str) -> list[float]:
        read = list(map(self.__getitem__, text.lower().split()))
        n = len(read)
        hits = [i for i, r in enumerate(read) if r[0]]
        weights = [read[i][0] for i in hits]
        near = sum(any(r[1] for r in read[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        size = max(len(text), 1)
        capitals = _capitals(text)
        return [math.log1p(n), len(hits), len(hits) / max(n, 1), sum(weights), max(weights, default=0.0), sum(weights) / max(len(hits), 1), near, capitals / size, sum(map(text.count, ".,;:!?*")) / size, text.count("!") / size, sum(r[2] for r in read) / max(n, 1)]


@cache
def _upper() -> np.ndarray:
    """Whether each code point is a capital."""
    return np.fromiter((chr(c).isupper() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _capitals(text: str) -> int:
    """Capitals of any script; in short texts one by one, in longer ones by table."""
    if len(text) < 64:
        return sum(map(str.isupper, text))
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        return int(((codes >= 65) & (codes <= 90)).sum())
    return int(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())


class Trees:
    """Boosted trees for logistic loss on binned features."""

    def __init__(self) -> None:
        self.start, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        # Weights of mean 1, so that RIDGE means the same for every sample.
        w = np.ones(len(y)) if weight is None else weight / weight.mean()
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        p = min(max(np.average(y, weights=w), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        margin = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, w * (p - y), w * p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            margin += self._walk(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple | float:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -RATE * total_g / (total_h + RIDGE)
        if not depth or len(rows) < 20:
            return float(leaf)
        best = (1e-6, 0, 0)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            left_g, left_h = np.cumsum(np.bincount(b, g[rows], BINS))[:-1], np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
            gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), f, k))
        if best[0] <= 1e-6:
            return float(leaf)
        _, f, k = best
        goes = binned[rows, f] <= k
        return (f, k, self._grow(binned, g, h, rows[goes], depth - 1), self._grow(binned, g, h, rows[~goes], depth - 1))

    def _walk(self, tree: tuple | float, binned: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(binned), tree)
        f, k, low, high = tree
        return np.where(binned[:, f] <= k, self._walk(low, binned), self._walk(high, binned))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.start + sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to ``y``, by pooling neighbours that fall."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # margin, mean, weight
    weight = np.ones(len(y)) if weight is None else weight
    for m, v, w in zip(margin[order], y[order], weight[order]):
        pools.append([m, v, w])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            m2, v2, w2 = pools.pop()
            m1, v1, w1 = pools.pop()
            w = w1 + w2
            pools.append([(m1 * w1 + m2 * w2) / w, (v1 * w1 + v2 * w2) / w, w])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


class Model:
    """Lexicon, trees and curve; small enough to travel with each task."""

    def __init__(self, lexicon: dict[str, float], base: float) -> None:
        self.lexicon, self.base = lexicon, base
        self.trees: Trees | None = None
        self.knots = (np.zeros(1), np.zeros(1))

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(features):
            return np.full(len(features), self.base)
        margin = self.trees.margin(features)
        # A grain of the trees' own probability keeps the order within flat stretches of the curve.
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def lexicon_of(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of the terms that toxic documents favour most surely."""
    found = []
    for term, a in toxic.items():
        if a < SUPPORT:
            continue
        b = clean.get(term, 0)
        odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds > 1 and z > 2:
            found.append((z, term, odds))
    return {term: odds for _, term, odds in sorted(found, reverse=True)[:TERMS]}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    learn = F.crc32(F.col(id_col).cast("string")) % HELD_OUT_OF != 0
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    labelled = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Training labels for each sampled one.
    stands = {y: max(labelled.get(y, 0) / most, 1.0) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))}
    chosen = [known.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    # At most MOST_TOXIC + MOST_CLEAN ids of 12 bytes: small at any size of the tables.
    sample = F.broadcast(cut(chosen[0].unionByName(chosen[1]), "toxicity-sample"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "id")
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)).cast("int")), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update({t for w in set(text.lower().split()) for t in terms(w.strip(EDGES)) if t})
        for y, c in enumerate(counts):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "y", "n"])

    first = rows.where("part < 4")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = stands[1] * totals.get(1, 0) / max(sum(stands[k] * n for k, n in totals.items()), 1)
    if not (totals.get(0) and totals.get(1)):
        return Model({}, base)
    sizes = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by_class = [F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "toxic"), (0, "clean"))]
    frequent = first.select("text", "y").mapInArrow(count, "term string, y int, n long").groupBy("term").agg(*by_class).where(f"toxic >= {SUPPORT}")
    # Terms by how far they favour the toxic class; the sample bounds their number.
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    top = frequent.where(odds > 1).orderBy((odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))).desc(), "term").limit(4 * TERMS).collect()
    model = Model(lexicon_of(Counter({r["term"]: r["toxic"] for r in top}), Counter({r["term"]: r["clean"] for r in top}), sizes.get(1, 0), sizes.get(0, 0)), base)
    seen = featured(rows.where("part >= 4").select("id", "text", "y", "part"), model.lexicon).collect()
    x = np.array([r["features"] for r in seen]).reshape(len(seen), len(FEATURES))
    y, part = (np.array([r[c] for r in seen], dtype=np.float64) for c in ("y", "part"))
    fit, check = part < 8, part >= 8
    if min(y[fit].sum(), (1 - y[fit]).sum(), y[check].sum(), (1 - y[check]).sum()) < 1:
        fit = check = np.ones(len(y), bool)
    if len(y) and 0 < y.sum() < len(y):
        weight = np.where(y == 1, stands[1], stands[0])
        model.trees = Trees().fit(x[fit], y[fit], weight[fit])
        model.knots = isotonic(model.trees.margin(x[check]), y[check], weight[check])
    return model


def featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in slices(batches):
            made = [reader.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(made, pa.list_(pa.float64()))], names=["id", "y", "part", "features"])

    return rows.mapInArrow(run, "id long, y int, part int, features array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in slices(batches):
            x = np.array([reader.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, whole and in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = Reader(model.lexicon), names.index(text_col)
        for batch in slices(batches):
            x = np.array([reader.features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
