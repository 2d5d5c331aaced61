"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; the path may be in any store that Spark can read. Executors get the package, as operators run Python there."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
