"""Language-model scoring by a hidden Markov model over words.

Words are runs of anything but ASCII spaces, A-Z lower-cased; each text ends in one end token. Counts of all training tokens
give the base score. The model's symbols are the CLASSES most frequent tokens and one class for all the rest; a word of the
rest has its share of that class by smoothed counts, unseen words the share of a count of zero. A start is trained on
SAMPLE_DOCS texts; then Baum-Welch runs over all training texts: each task sums its expected counts, which are added up by
symbol, so what moves is a small table whatever the input. The likelihood of a text is exact, by scaled forward recursion over
all of its tokens.

Counts of the most frequent tokens, HEAD of them at most and all above some count, go to the tasks, a bounded table. Tokens beyond it meet the whole count table in a join,
as rows of text key, word and occurrences.

Defined cases: a null or empty text is its end token alone; a null id counts as empty text in the split; repeated rows are
texts of their own; with no training text every token has probability one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import ascii_words, id_bucket, row_keys, staged, texts_of

END = b"\n"
COPY = b""  # no token: marks the rows that share a key
ADDED = 0.1
HEAD = 1 << 17
CLASSES = 1 << 13
STATES = 6
SAMPLE_DOCS = 400
SAMPLE_ROUNDS = 15
CORPUS_ROUNDS = 2
PRIOR_TOKENS = 200.0
HELD_COUNTS = 250_000
CELL_TOKENS = 1 << 19
TOGETHER = 1024
SLICE_ROWS = 2048


def tokens(text: bytes) -> list[bytes]:
    return [*ascii_words(text), END]


@dataclass
class Model:
    """start (K), moves (K x K) and emissions (symbols x K)."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray


def _together(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of like length side by side: their places in ``texts``, the symbols by time, and how many are not over yet."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        n = max(1, min(TOGETHER, CELL_TOKENS // max(1, longest), len(order) - at))
        mine = order[at : at + n]
        lengths = np.array([len(texts[i]) for i in mine])
        grid = np.zeros((longest, n), np.int32)
        for column, i in enumerate(mine):
            grid[: lengths[column], column] = texts[i]
        yield mine, grid, (lengths[None, :] > np.arange(longest)[:, None]).sum(1)
        at += n


def likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of each symbol sequence's probability."""
    out = np.zeros(len(texts))
    for mine, grid, alive in _together(texts):
        total = np.zeros(len(mine))
        forward = np.tile(model.start, (len(mine), 1))
        for t, n in enumerate(alive):
            ahead = (forward[:n] if t == 0 else forward[:n] @ model.moves) * model.emissions[grid[t, :n]]
            scale = ahead.sum(1)
            forward[:n] = ahead / scale[:, None]
            total[:n] += np.log10(scale)
        out[mine] = total
    return out


def expected(texts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over some texts."""
    k, symbols = len(model.start), len(model.emissions)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for mine, grid, alive in _together(texts):
        forward = np.zeros((len(alive), len(mine), k))
        scales = np.ones((len(alive), len(mine)))
        for t, n in enumerate(alive):
            ahead = (model.start if t == 0 else forward[t - 1, :n] @ model.moves) * model.emissions[grid[t, :n]]
            scales[t, :n] = ahead.sum(1)
            forward[t, :n] = ahead / scales[t, :n, None]
        backward = np.ones((len(mine), k))
        seen, symbols_seen = [], []
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            seen.append(forward[t, :n] * backward[:n])
            symbols_seen.append(grid[t, :n])
            onward = model.emissions[grid[t, :n]] * backward[:n] / scales[t, :n, None]
            if t:
                moves += forward[t - 1, :n].T @ onward
                backward[:n] = onward @ model.moves.T
        starts += seen[-1].sum(0)
        shares, flat = np.concatenate(seen), np.concatenate(symbols_seen)
        for state in range(k):
            emissions[:, state] += np.bincount(flat, shares[:, state], symbols)
    return starts, moves * model.moves, emissions


def maximised(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts; ``prior`` shares keep every symbol possible in every state."""
    k = len(starts)
    moves = moves + 1.0 + 8.0 * np.eye(k)
    emissions = emissions + PRIOR_TOKENS * prior[:, None]
    return Model((starts + 1.0) / (starts + 1.0).sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))


def started(texts: list[np.ndarray], prior: np.ndarray, states: int = STATES, rounds: int = SAMPLE_ROUNDS, seed: int = 5) -> Model:
    """A model of a small sample: each state begins with the symbols of a share of its texts."""
    rng = np.random.default_rng(seed)
    emissions = np.zeros((len(prior), states))
    if texts:
        profiles = np.stack([np.bincount(t, minlength=len(prior)) / len(t) for t in texts])
        roots = np.sqrt(profiles)
        centres = roots[[int(rng.integers(len(texts)))]]
        while len(centres) < min(states, len(texts)):  # the text least like the centres so far
            centres = np.vstack([centres, roots[int(np.argmin((roots @ centres.T).max(1)))]])
        for _ in range(6):
            nearest = (roots @ centres.T).argmax(1)
            centres = np.stack([roots[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        for c in range(len(centres)):
            emissions[:, c] = sum((np.bincount(t, minlength=len(prior)) for t, own in zip(texts, nearest) if own == c), np.zeros(len(prior)))
    model = maximised(np.ones(states), np.eye(states) * 50, emissions, prior)
    for _ in range(rounds if texts else 0):
        model = maximised(*expected(texts, model), prior)
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts_of(batch.column(0)):
            held.update(tokens(text))
            if len(held) > HELD_COUNTS:
                yield out()
                held.clear()
    yield out()


def counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens of ``texts.text``."""
    return texts.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head's counts, the symbols among them, and the totals of all training tokens."""

    head: dict[bytes, int]
    symbols: dict[bytes, int]
    total: int
    distinct: int

    @property
    def base_total(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    @property
    def rare_total(self) -> float:
        inside = sum(self.head[w] for w in self.symbols)
        return self.total - inside + ADDED * (self.distinct - len(self.symbols) + 1)

    def prior(self) -> np.ndarray:
        shares = np.array([self.head[w] for w in self.symbols] + [0.0])
        shares[-1] = self.total - shares.sum() + 1.0
        return shares / shares.sum()


def vocabulary(counted: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Vocabulary:
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by_count = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = by_count.filter(F.col("upto") <= head).agg(F.min("n")).first()[0]
    rows = counted.filter(F.lit(False) if least is None else F.col("n") >= least).toPandas()
    rows["word"] = [bytes(w) for w in rows["word"]]
    rows = rows.sort_values(["n", "word"], ascending=[False, True])
    words = rows["word"].tolist()
    return Vocabulary(dict(zip(words, map(int, rows["n"]))), {w: i for i, w in enumerate(words[:classes])}, int(total), int(distinct))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE_ROWS rows at most, as what is held for a row in Python is many times its text."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(begin, SLICE_ROWS)


def _symbols_of(words: list[bytes], symbols: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(symbols.get, words, repeat(len(symbols))), np.int32, len(words))


def _expectation(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, model = shipped.value
        k, rows = len(model.start), len(model.emissions)
        table = np.zeros((rows + k + 1, k))
        for batch in _slices(batches):
            texts = [_symbols_of(tokens(t), symbols) for t in texts_of(batch.column(0))]
            if texts:
                starts, moves, emissions = expected(texts, model)
                table[:rows] += emissions
                table[rows : rows + k] += moves
                table[rows + k] += starts
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, i]) for i in range(k))], ["at", *(f"s{i}" for i in range(k))])

    return run


def baum_welch(texts: DataFrame, words: Vocabulary, model: Model, rounds: int = CORPUS_ROUNDS) -> Model:
    """Rounds over all of ``texts``: expected counts are summed within tasks, then by symbol."""
    k, rows, prior = len(model.start), len(words.symbols) + 1, words.prior()
    names = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        shipped = texts.sparkSession.sparkContext.broadcast((words.symbols, model))
        summed = texts.select("text").mapInArrow(_expectation(shipped), "at long, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        table = np.zeros((rows + k + 1, k))
        table[summed["at"].to_numpy(np.int64)] = summed[names].to_numpy()
        model = maximised(table[rows + k], table[rows : rows + k], table[:rows], prior)
    return model


def _scored(shipped):
    names = ["k1", "k2", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, whole = shipped.value
        head, symbols = words.head, words.symbols
        base_log, rare_log = math.log10(words.base_total), math.log10(words.rare_total)
        logs = {w: math.log10(c + ADDED) for w, c in head.items()}
        unseen = math.log10(ADDED)
        for batch in _slices(batches):
            out, texts, tail = [], [], []
            for k1, k2, doc_id, held_out, text in zip(*(batch.column(i).to_pylist() for i in range(4)), texts_of(batch.column(4))):
                own = tokens(text)
                known, base, rare, more = 0, 0.0, 0.0, {}
                for word, times in Counter(own).items():
                    log = logs.get(word)
                    if log is None:
                        if not whole:
                            more[word] = times
                            continue
                        log = unseen
                    else:
                        known += times
                    base += times * (log - base_log)
                    if word not in symbols:
                        rare += times * (log - rare_log)
                texts.append(_symbols_of(own, symbols))
                out.append((k1, k2, doc_id, held_out, len(own), known, base, rare, None, None))
                if more:
                    tail.append((k1, k2, COPY, 1))
                    tail += [(k1, k2, w, n) for w, n in more.items()]
            if not out:
                continue
            columns = [list(c) for c in zip(*out)]
            columns[7] = list(np.array(columns[7]) + likelihoods(texts, model))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            if tail:
                k1s, k2s, tail_words, times = (list(c) for c in zip(*tail))
                empty = [pa.nulls(len(k1s), t) for t in types[2:8]]
                yield pa.RecordBatch.from_arrays([pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), *empty, pa.array(tail_words, pa.binary()), pa.array(times, pa.int64())], names)

    return run


def score(docs: DataFrame, folds: int = 10, head: int = HEAD, classes: int = CLASSES, states: int = STATES, rounds: int = CORPUS_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; texts with remainder 0 are held out."""
    docs = docs.select("doc_id", "text").withColumn("held_out", id_bucket("doc_id", folds) == 0)
    training = docs.filter(~F.col("held_out"))
    counted = staged(counts(training))
    words = vocabulary(counted, head, classes)
    chosen = training.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = training.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text").orderBy("doc_id").limit(SAMPLE_DOCS).toPandas()
    model = started([_symbols_of(tokens((t or "").encode()), words.symbols) for t in sample["text"]], words.prior(), states)
    model = baum_welch(training, words, model, rounds)
    whole = words.distinct <= len(words.head)
    shipped = docs.sparkSession.sparkContext.broadcast((words, model, whole))
    schema = "k1 long, k2 long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, times long"
    row = ["k1", "k2"]
    rows = docs.select(*(k.alias(n) for k, n in zip(row_keys("doc_id", "text"), row)), F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(_scored(shipped), schema)
    fields = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"]
    if whole:
        return rows.select(*fields)
    rows = staged(rows)
    is_copy = F.col("word") == F.lit(COPY)
    # one mark a text, as many as texts: they must not meet the counts, where they would all be one key
    copies = rows.filter(is_copy).select(*row, "times", F.lit(None).cast("long").alias("n"))
    seen = rows.filter(~is_copy).select(*row, "word", "times").join(counted, "word", "left").select(*row, "times", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.log10(F.col("n") + ADDED)
    tails = copies.unionByName(seen).groupBy(*row).agg(
        F.sum(F.when(F.col("n").isNull(), F.col("times"))).alias("copies"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.coalesce(F.sum(F.col("times") * (log - math.log10(words.base_total))), F.lit(0.0)).alias("tail_base"),
        F.coalesce(F.sum(F.col("times") * (log - math.log10(words.rare_total))), F.lit(0.0)).alias("tail_rare"),
    )
    share = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    joined = rows.filter("word IS NULL").join(tails, row, "left")
    joined = joined.withColumn("n_known", (F.col("n_known") + share("tail_known")).cast("long")).withColumn("base_score", F.col("base_score") + share("tail_base")).withColumn("score", F.col("score") + share("tail_rare"))
    return joined.select(*fields)
