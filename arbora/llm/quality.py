"""Quality by hierarchical empirical Bayes.

A document's own evidence is the probability of a logistic model over simple measures of its whole text. Sites and their paths
add theirs: the mean evidence of a host's documents is shrunk toward the global mean, and the mean of a path's documents toward
its host's, each as a beta posterior whose prior strength comes from how much hosts (and paths) differ, by the method of
moments. A sparse site therefore says little. The document's log-odds are moved by how far its path's posterior lies from the
global mean. Sites are met by grouped aggregation alone: sums and counts, combined before they are shuffled.

The model is trained on TRAIN_DOCS labelled documents at most, those with the least hash of the id. Defined cases: null and
empty texts have zero measures; null hosts and paths are groups of their own; with no labels or a single class every document
has the same own evidence; repeated rows are judged alike, each counts for its site; further columns pass through ``judged``,
those with the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from arbora.llm.common import joined_hot, staged, texts_of
from arbora.llm.toxicity import training_rows

TRAIN_DOCS = 8000
MARKS = b"!$%#&*|@~^<>{}[]\\_=+"
KEPT = 0.5
BROADCAST_SITES = 100_000
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
RESULTS = ("evidence", "host_posterior", "path_posterior", "quality_score")
_UPPER, _LOWER, _DIGIT, _MARK = (np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", MARKS))


def measures(text: bytes) -> list[float]:
    """Shares that tell prose from shouting, decoration, tables and repetition, and the logs of lengths."""
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = bytes_of[_UPPER].sum() + bytes_of[_LOWER].sum()
    words = text.split()
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    stops = bytes_of[ord(".")] + bytes_of[ord("?")]
    shares = [
        bytes_of[_UPPER].sum() / max(1, letters),
        bytes_of[_MARK].sum() / n,
        bytes_of[ord("!")] / n,
        bytes_of[ord("|")] / n,
        again / n,
        bytes_of[_DIGIT].sum() / max(1, len(text)),
        stops / n,
        1.0 - len(set(words)) / n,
    ]
    return [*shares, *(np.log(x + 0.01) for x in shares), np.log1p(len(words)), len(text) / n]


SIZE = len(measures(b""))


class Logistic:
    """Standardised measures into a log-odds."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, bias: float):
        self.centre, self.spread, self.weights, self.bias = centre, spread, weights, bias

    @classmethod
    def train(cls, rows: np.ndarray, labels: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> Logistic:
        """Newton steps with a quadratic penalty."""
        if len(set(labels.tolist())) < 2:
            mean = (labels.sum() + 0.5) / (len(labels) + 1.0)
            return cls(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), float(np.log(mean / (1 - mean))))
        centre, spread = rows.mean(0), rows.std(0) + 1e-9
        x = np.c_[(rows - centre) / spread, np.ones(len(rows))]
        w, ridge = np.zeros(x.shape[1]), np.diag([*[penalty] * SIZE, 1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (labels - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(centre, spread, w[:-1], float(w[-1]))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((rows - self.centre) / self.spread @ self.weights + self.bias, -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Logistic:
    rows = training_rows(docs, labels, F.lit(True) if allowed is None else allowed, "quality", TRAIN_DOCS).toPandas().sort_values("doc_id")
    measured = np.array([measures(t.encode()) for t in rows["text"]]).reshape(-1, SIZE)
    return Logistic.train(measured, rows["label"].to_numpy(float))


def with_evidence(docs: DataFrame, model: Logistic) -> DataFrame:
    """``docs`` with evidence, the probability that a document by itself is good."""
    docs = docs.drop("evidence")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            found = shipped.value.probability(np.array([measures(t) for t in texts]).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "evidence"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("evidence", DoubleType())]))


def _strength(groups: DataFrame, mean: Column, within: Column) -> float:
    """A beta prior's strength from the spread of group means, less what groups' sizes explain; the same for all groups."""
    row = groups.filter(F.col("n") > 1).agg(F.avg(F.pow(mean - within, 2)).alias("spread"), F.avg(within * (1 - within) / F.col("n")).alias("noise"), F.avg(within).alias("mean")).first()
    if row["spread"] is None:
        return MOST_STRENGTH
    own = row["spread"] - row["noise"]
    return MOST_STRENGTH if own <= 0 else float(np.clip(row["mean"] * (1 - row["mean"]) / own - 1, LEAST_STRENGTH, MOST_STRENGTH))


def site_posteriors(evidence: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) and the global mean."""
    paths = evidence.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.sum("evidence").alias("good"), F.count("*").alias("n"))
    paths = staged(paths)
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    overall = (total[0] + 0.5) / (total[1] + 1.0) if total[1] else 0.5
    hosts = paths.groupBy("__host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    strength = _strength(hosts, F.col("good") / F.col("n"), F.lit(overall))
    hosts = hosts.select("__host", ((F.lit(strength * overall) + F.col("good")) / (F.lit(strength) + F.col("n"))).alias("host_posterior"))
    both = paths.join(hosts.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
    strength = _strength(both, F.col("good") / F.col("n"), F.col("host_posterior"))
    return both.select("__host", "__path", "host_posterior", ((strength * F.col("host_posterior") + F.col("good")) / (strength + F.col("n"))).alias("path_posterior")), overall


def judged(docs: DataFrame, model: Logistic, host: str = "source", path: str = "lang", texts: bool = True) -> DataFrame:
    """``docs``, without their texts unless ``texts``, with evidence, host_posterior, path_posterior and quality_score (a probability).

    Texts are measured once; what is written holds the evidence beside the columns that go on."""
    measured = with_evidence(docs.drop(*RESULTS), model)
    own = staged(measured if texts else measured.drop("text"))
    sites, overall = site_posteriors(own.select(host, path, "evidence"), host, path)
    if sites.count() <= BROADCAST_SITES:
        met = own.join(F.broadcast(sites), F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left").drop("__host", "__path")
    else:
        site = lambda h, p: F.to_json(F.struct(F.col(h).alias("h"), F.col(p).alias("p")))  # noqa: E731  nulls are left out, so they differ from empty texts
        met = joined_hot(own.withColumn("__site", site(host, path)), sites.withColumn("__site", site("__host", "__path")).drop("__host", "__path"), "__site", "left").drop("__site")
    odds = lambda p: F.log(p / (1 - p))
    moved = odds(F.col("evidence")) + odds(F.col("path_posterior")) - float(np.log(overall / (1 - overall)))
    return met.withColumn("quality_score", 1 / (1 + F.exp(-moved)))
