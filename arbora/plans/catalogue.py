"""Every named query of the engine with its SQL twin, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("tree_queries", "join_queries", "window_queries", "aggregate_queries", "text_queries", "structure_queries", "record_queries", "compare_queries", "page_queries", "owner_queries", "report_queries", "island_queries")


def _collected(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"arbora.plans.{name}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collected("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collected("ORACLES")
