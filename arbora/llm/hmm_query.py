"""op6: hidden Markov scores of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm.hmm import score
from arbora.sources.tables import table

FOLDS = 10


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), FOLDS)


QUERIES = {"op6_hmm_score": op6_hmm_score}
ORACLES: dict[str, str] = {}
