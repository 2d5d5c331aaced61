"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.sources.staging import release as release
from arbora.sources.staging import staged as staged

HOT_ROWS = 100_000
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's content; equal rows share it, nulls count as values."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\0")) for c in columns]
    return F.xxhash64(*parts)


def row_keys(*columns: str) -> list[Column]:
    """``row_key`` and a second hash in the reverse order: 128 bits that tell rows apart at any size."""
    return [row_key(*columns), row_key(*reversed(columns))]


def joined_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which has a key once, where a key may hold a large share of ``rows``.

    Keys of more than ``hot_rows`` rows, of which there are at most a ``hot_rows``-th as many as rows, meet their line of the
    table by broadcast, so that their rows stay where they are; all others are shuffled."""
    hot = staged(rows.groupBy(key).count().filter(F.col("count") > hot_rows).select(key))
    if hot.isEmpty():
        return rows.join(table.hint("merge"), key, how)
    few = staged(table.join(F.broadcast(hot), key, "left_semi"))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table.hint("merge"), key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how))


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of an id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 bytes of a text column, null as empty; only ``rows`` texts are copied at a time."""
    for begin in range(0, len(column), rows):
        for value in column.slice(begin, rows).cast(pa.large_binary()).to_pylist():
            yield value or b""


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but the six ASCII spaces, A-Z lower-cased."""
    return text.lower().split()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their rank from 0 in ``order``, by ranks within ranges and counts of the ranges before."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # as many rows as partitions
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")
