"""Request and token budgets over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budgets(calls: DataFrame, at: str = "ts", tokens: str = "tokens", span: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests and tokens in sliding windows of event time; calls later than ``late`` are left out.

    Works on a streaming and on a static DataFrame."""
    windows = F.window(F.col(at).cast("timestamp"), span, slide).alias("window")
    timed = calls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(windows).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "tokens")
