"""op1: toxicity of ``documents``, learnt from the labels that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import id_bucket
from arbora.llm.toxicity import fit, score
from arbora.sources.tables import table

FOLDS, HELD_OUT, CUT = 4, 2, 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", FOLDS) != HELD_OUT)
    return score(docs, model).select("doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
