"""Connected components of an edge table by alternating large-star and small-star steps.

A hub may hold a large share of the edges; where there are enough for one to be hot, hubs meet their least neighbour by broadcast.
What tells whether a round changed anything is counted while its edges are written, not by a job of its own: each exchange and
each job leaves a thread on the driver for a minute.

Defined cases: loops and repeated edges are harmless; no edges give no nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arbora.llm.common import HOT_ROWS, joined_hot, release, staged


def _met(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return joined_hot(edges, least, "a") if many else edges.join(least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return _met(both.filter("b > a"), least, many).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = _met(down, least, many)
    return linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()


def _staged_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` (a, b) staged, and their number and the sum of their hashes."""
    seen = Observation()
    written = staged(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
    return written, (seen.get["n"], seen.get["hashes"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the component's least node. Loops and repeats are harmless."""
    stars, before = _staged_edges(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        many = before[0] > HOT_ROWS
        larger = _large_star(stars, many)
        stars, after = _staged_edges(_small_star(staged(larger) if many else larger, many))
        release(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
