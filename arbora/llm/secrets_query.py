"""op5: secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.secrets import scan
from arbora.sources.tables import table


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_random", "tested")


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
