"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and its whole form, so an unseen misspelling shares most of a known word's
vectors. A window of WINDOW words is the average of its words' vectors, and a linear softmax gives the window's probability. A
document's score is that of its worst window, so a few words in a long text count as much as in a short one. Vectors and
softmax are trained together: first on whole documents, then on each document's worst window under the model so far.

As the softmax is linear, a word's part in a window is one number, the mean of its n-grams' parts; only those parts of the
hash buckets, a fixed-size array, go to the executors.

Training takes TRAIN_DOCS labelled documents at most, those with the least hash of the id. Defined cases: null and empty texts
get the score of an empty bag; labels that are null are no labels, of repeated labels the greatest counts; with no labels or
a single class the score is the same for all; of texts that share an id the least one trains; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import texts_of

TRAIN_DOCS = 6000
NEGATIVES = 3
BUCKETS = 1 << 16
DIMENSIONS = 12
GRAMS = (3, 4, 5)
WINDOW = 16
CACHED_WORDS = 200_000
_EDGE = re.compile(r"^\W+|\W+$")


def tokens(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w for w in (_EDGE.sub("", x) if not x.isalnum() else x for x in text.lower().split()) if w]


def grams(word: str) -> list[int]:
    """Buckets of a word: its whole form and its character n-grams with marked ends."""
    marked = f"<{word}>"
    parts = [f"={word}"] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class Bags:
    """Words of a set of documents as one table of n-gram buckets."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.docs = [np.array([index.setdefault(w, len(index)) for w in tokens(t)], np.int64) for t in texts]
        bags = [grams(w) for w in index]
        self.flat = np.fromiter((g for b in bags for g in b), np.int64)
        self.starts = np.cumsum([0, *map(len, bags)])
        self.words = len(bags)

    def word_parts(self, parts: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(0)
        return np.add.reduceat(parts[self.flat], self.starts[:-1]) / np.diff(self.starts)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of some words and the weight of each in the words' average; a word that recurs is looked up once."""
        once, times = np.unique(words, return_counts=True)
        lengths = self.starts[once + 1] - self.starts[once]
        offsets = np.repeat(self.starts[once] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        return self.flat[offsets], np.repeat(times / (lengths * len(words)), lengths)


def worst_window(parts: np.ndarray, window: int = WINDOW) -> tuple[int, float]:
    """Start and mean part of the window with the greatest mean; a shorter text is one window."""
    if len(parts) <= window:
        return 0, float(parts.mean()) if len(parts) else 0.0
    sums = np.r_[0.0, np.cumsum(parts)]
    means = (sums[window:] - sums[:-window]) / window
    at = int(np.argmax(means))
    return at, float(means[at])


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, whole_epochs: int = 3, full_epochs: int = 2, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """The part of each bucket in the log-odds, and the bias. All but the last ``full_epochs`` take NEGATIVES negatives a positive."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    seen_vectors, seen_softmax, seen_bias = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((2, DIMENSIONS), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        parts = bags.word_parts(vectors @ (softmax[1] - softmax[0])) if epoch >= whole_epochs else None
        chosen = np.flatnonzero(labels == 1)
        others = np.flatnonzero(labels == 0)
        wanted = len(others) if epoch >= epochs - full_epochs else min(len(others), NEGATIVES * len(chosen))
        for i in rng.permutation(np.r_[chosen, rng.choice(others, wanted, replace=False)]):
            words = bags.docs[i]
            if not len(words):
                continue
            if parts is not None:
                at, _ = worst_window(parts[words])
                words = words[at : at + WINDOW]
            rows, weights = bags.of(words)
            mean = weights.astype(np.float32) @ vectors[rows]
            logits = softmax @ mean + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[int(labels[i])] -= 1.0
            to_softmax, to_mean = np.outer(wrong, mean), wrong @ softmax
            seen_softmax += to_softmax**2
            seen_bias += wrong**2
            softmax -= rate * to_softmax / np.sqrt(seen_softmax)
            bias -= rate * wrong / np.sqrt(seen_bias)
            once, back = np.unique(rows, return_inverse=True)
            share = np.bincount(back, weights, len(once)).astype(np.float32)[:, None]
            step = share * to_mean
            seen_vectors[once] += (step**2).mean(1, keepdims=True)
            vectors[once] -= rate * step / np.sqrt(seen_vectors[once])
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts; the parts of words met so far are kept, CACHED_WORDS at most."""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias, self.known = parts, bias, {}

    def part(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            rows = grams(word)
            found = self.known[word] = float(self.parts[rows].mean())
        return found

    def score(self, text: str) -> float:
        of, known = self.part, self.known
        parts = np.array([known[w] if w in known else of(w) for w in tokens(text)])
        return float(1.0 / (1.0 + np.exp(-np.clip(worst_window(parts)[1] + self.bias, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "toxic", most: int = TRAIN_DOCS) -> DataFrame:
    """(text, label) of ``most`` labelled documents at most: a bounded set of ids meets ``docs``, whose texts never move."""
    chosen = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "toxic") -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, allowed, column).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["label"].to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shipped.value)
        for batch in batches:
            found = [scorer.score(t.decode()) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
