"""op9: mixing all ``documents`` to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm.mixing import mix
from arbora.sources.tables import table


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
