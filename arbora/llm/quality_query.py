"""op2: quality of ``documents``; a document's source is its host, its language the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import id_bucket
from arbora.llm.quality import KEPT, fit, judged
from arbora.sources.tables import table

FOLDS, HELD_OUT = 4, 2


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", FOLDS) != HELD_OUT)
    held_out = (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return judged(docs, model, texts=False).select("doc_id", held_out, "evidence", "host_posterior", "path_posterior", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEPT).alias("keep"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
