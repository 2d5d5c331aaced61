"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("toxicity_query", "quality_query", "url_query", "line_query", "secrets_query", "hmm_query", "decontamination_query", "simhash_query", "mixing_query", "media_query")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"arbora.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"arbora.llm.{m}").ORACLES.items()}
