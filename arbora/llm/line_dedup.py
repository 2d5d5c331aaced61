"""Line deduplication by a sharded minimal perfect hash over all distinct line keys.

A line's key is the line without ASCII spaces at its ends and with A-Z lower-cased. Keys are hashed to 128 bits: 64 address a
shard and its perfect hash, 32 are kept as the slot's fingerprint. Each shard holds a levelled bit-array hash and two arrays,
fingerprints and document counts. The documents' distinct keys go to the shards as fixed-size rows and probe the arrays there;
only the keys found common travel back. A shard is copied to as many salts as its own rows ask for; the salts of shards that
need more than one are broadcast up to BROADCAST_SHARDS of them and joined beyond that.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; each row counts as a document, also where
ids repeat or are null; an empty table gives an empty result; further columns pass through, and a column with the name of a
result column is replaced.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from arbora.llm.common import ASCII_SPACE, row_keys, staged, texts_of

SHARD_KEYS = 1 << 17
SALT_ROWS = 1 << 18
BROADCAST_SHARDS = 1_000_000
ROW = ["k1", "k2"]
MOST_COUNTED = (1 << 16) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line."""
    return [line.strip(ASCII_SPACE) for line in text.lower().split(b"\n")]


def hashed(key: bytes) -> tuple[int, int]:
    """Signed 64-bit address and signed 32-bit fingerprint of a key."""
    whole = xxhash.xxh3_128_intdigest(key)
    low, high = whole & 0xFFFFFFFFFFFFFFFF, (whole >> 64) & 0xFFFFFFFF
    return low - (1 << 64) * (low >> 63), high - (1 << 32) * (high >> 31)


class PerfectHash:
    """Minimal perfect hash: each level places the keys that fall alone on a bit, the rest go to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, start = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(start + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            start += int(ones.sum())
        self.size = start

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        mixed = (keys ^ np.uint64(level * 0x5851F42D + 1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct unsigned 64-bit keys."""
        levels: list[np.ndarray] = []
        while keys.size:
            bits = max(64, -(-int(1.6 * keys.size) // 64) * 64)
            places = cls._places(keys, len(levels), bits)
            hits = np.bincount(places, minlength=bits)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            keys = keys[hits[places] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it; keys never built in may get any slot."""
        found = np.full(keys.size, -1, np.int64)
        todo = np.arange(keys.size)
        for level, words in enumerate(self.levels):
            if not todo.size:
                break
            places = self._places(keys[todo], level, words.size * 64)
            word, bit = words[places >> 6], (places & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[todo[here]] = (self.ranks[level][places >> 6] + below)[here]
            todo = todo[~here]
        return found


def build_shard(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard's hash, fingerprint array and count array. Keys equal in all 64 bits but not in the fingerprint go to a list."""
    _, first = np.unique(keys, return_index=True)
    alone = np.zeros(keys.size, bool)
    alone[first] = True
    index = PerfectHash.build(keys[alone].view(np.uint64))
    slots = index.slots(keys[alone].view(np.uint64))
    kept_prints, kept_counts = np.zeros(index.size, np.int32), np.zeros(index.size, np.uint16)
    kept_prints[slots] = prints[alone]
    kept_counts[slots] = np.minimum(counts[alone], MOST_COUNTED)
    more = {(int(k), int(p)): int(c) for k, p, c in zip(keys[~alone], prints[~alone], counts[~alone])}
    return pickle.dumps((index.levels, kept_prints, kept_counts, more))


class Shard:
    """A shard ready to be probed."""

    def __init__(self, blob: bytes):
        levels, self.prints, self.counts, self.more = pickle.loads(blob)
        self.index = PerfectHash(levels)

    def counted(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Documents that hold each key (at most MOST_COUNTED); 0 for a key that is not in the shard."""
        slots = self.index.slots(keys.view(np.uint64))
        known = slots >= 0
        known[known] = self.prints[slots[known]] == prints[known]
        counts = np.where(known, self.counts[np.where(known, slots, 0)] if self.counts.size else 0, 0).astype(np.int64)
        for i in np.flatnonzero(~known) if self.more else ():
            counts[i] = self.more.get((int(keys[i]), int(prints[i])), 0)
        return counts


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys, prints = [], [], []
        for row, text in enumerate(texts_of(batch.column(2))):
            for key in set(line_keys(text)):
                if key:
                    address, fingerprint = hashed(key)
                    rows.append(row)
                    keys.append(address)
                    prints.append(fingerprint)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.int64()), pa.array(prints, pa.int32())], [*ROW, "key", "print"])


def _shard_of(group: pd.DataFrame) -> pd.DataFrame:
    blob = build_shard(group["key"].to_numpy(), group["print"].to_numpy(), group["n"].to_numpy())
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "blob": [blob]})


def _probe(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(kinds == 0)
            edges = [0, *starts, len(kinds)]
            k1s, k2s, keys, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
            for begin, end in zip(edges, edges[1:]):
                if begin < end and kinds[begin] == 0:
                    shard = Shard(batch.column(7)[int(begin)].as_py())
                    begin += 1
                if begin < end:
                    common = shard.counted(keys[begin:end], prints[begin:end]) >= least
                    if common.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[begin:end][common]) for x in (k1s, k2s, keys, prints)], [*ROW, "key", "print"])

    return run


def _with_salts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    return rows.join(hot, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))


def common_lines(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(k1, k2, key, print) of each line key that ``least_docs`` rows or more hold, for each row of ``docs`` (k1, k2, text) that holds it."""
    lines = staged(docs.mapInArrow(_emit_keys, "k1 long, k2 long, key long, print int"))
    counts = staged(lines.groupBy("key", "print").agg(F.count("*").alias("n")))
    distinct = counts.count()
    shards = max(1, math.ceil(distinct / SHARD_KEYS))
    counts = counts.withColumn("shard", F.pmod("key", F.lit(shards)))
    hot = staged(counts.groupBy("shard").agg(F.ceil(F.sum("n") / SALT_ROWS).alias("salts")).filter("salts > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_SHARDS else hot
    index = counts.groupBy("shard").applyInPandas(_shard_of, "shard long, blob binary")
    nothing = [F.lit(0).cast(t).alias(n) for n, t in (("k1", "long"), ("k2", "long"), ("key", "long"), ("print", "int"))]
    arrays = _with_salts(index, hot).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *nothing, "blob")
    probes = _with_salts(lines.withColumn("shard", F.pmod("key", F.lit(shards))), hot).select("shard", F.pmod("k1", "salts").alias("salt"), F.lit(1).alias("kind"), *ROW, "key", "print", F.lit(None).cast("binary").alias("blob"))
    return arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe(least_docs), "k1 long, k2 long, key long, print int")


def _rebuild(text: str, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = texts_of(batch.column(names.index(text)))
            drops = batch.column(names.index("__drop")).to_pylist()
            kept, before, gone = [], [], []
            for whole, drop in zip(texts, drops):
                lines = whole.split(b"\n")
                if drop:
                    unwanted = {(d["key"], d["print"]) for d in drop}
                    keep = [line for line, key in zip(lines, line_keys(whole)) if not key or hashed(key) not in unwanted]
                else:
                    keep = lines
                kept.append(b"\n".join(keep))
                before.append(len(lines))
                gone.append(len(lines) - len(keep))
            out = {n: batch.column(i) for i, n in enumerate(names) if n != "__drop"}
            out |= {text: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def dedup_lines(docs: DataFrame, least_docs: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every line dropped whose key stands in ``least_docs`` rows or more, and with n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped", "__drop")
    mine = row_keys(id_column, text)
    common = common_lines(docs.select(*(k.alias(n) for k, n in zip(mine, ROW)), F.col(text).alias("text")), least_docs)
    drops = common.groupBy(*ROW).agg(F.collect_set(F.struct("key", "print")).alias("__drop")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__drop")
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    met = docs.join(drops, (mine[0] == F.col("__k1")) & (mine[1] == F.col("__k2")), "left").drop("__k1", "__k2")
    return met.mapInArrow(_rebuild(text), schema)
