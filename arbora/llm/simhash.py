"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit set where over half of its features' XXH64 values have it. The anchors are the code words of a Hamming
code, which covers its space with radius 1: each point has exactly one anchor within 1, its home.

``linked_fingerprints`` finds exactly the pairs of distinct 64-bit fingerprints within ``bits`` (3 at most). Of two halves, one
holds ``bits // 2`` of the differences at most, so in that half the other fingerprint lies within 1 + ``bits // 2`` of the home.
Each fingerprint is therefore replicated, in each half, to every code word of the (31, 26) code that near, and compared with
the fingerprints at home there. Homes that many share are dealt again by bits + 1 parts of the
other half, one of which must agree.

``near_duplicates`` finds documents with a Jaccard similarity of 0.8 or more over the sets of their five-word shingles. It is a
prefix-filtered set join and finds every such pair's group: each text's shingles are put in one order of all shingles, and two
texts that similar share one of the first ``size - ceil(0.8 size) + 1`` of each. Any one order is right; shingles that many texts hold
come last (CARRIED of them, those counted over WINDOW times), so that few texts meet at them. Texts that meet at a shingle are compared
by whole sets: first each with a few of the group, and then, in two groups that this did not join, every pair that sizes
and places allow. Nothing is sampled. ``near_groups`` with ``bits``, as the pipeline has it, links all texts that
``simhash_groups`` links first; the set join then adds the pairs that are similar but further apart.

Defined cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle have one
feature, the whole; equal texts are one class before links are sought; rows with a null id get the id of their group, null if
it has none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import ascii_words, joined_hot, release, staged, texts_of
from arbora.llm.components import components

SEED = 42
CHUNK = 1 << 17
HOT_HOMES = 1024
WINDOW = 64
CARRIED = 1 << 17
BLOCK = 2048
CENTRES = 2
FILTER_WORDS = 18
SIMILAR = 0.8
ROUNDING = 1e-9
SHINGLE_WORDS = 5
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Space-joined runs of ``n`` words; the whole where there are fewer, none where there is no word."""
    if len(words) <= n:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(n))))


def digests(features, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 of each feature as rows of 8 bytes, most significant first, in chunks."""
    hash_of = partial(xxhash.xxh64_digest, seed=seed)
    features = iter(features)
    while True:
        part = b"".join(h for h, _ in zip(map(hash_of, features), range(CHUNK)))
        if not part:
            return
        yield np.frombuffer(part, np.uint8).reshape(-1, 8)


def majority(features, seed: int = SEED) -> np.ndarray:
    """8 bytes: the bits set in over half of the features' hashes; zeros where there is none."""
    ones, n = np.zeros((8, 8), np.int64), 0
    for part in digests(features, seed):
        n += len(part)
        for i in range(8):
            ones[i] += np.bincount(part[:, i], minlength=256) @ _BITS
    return np.packbits(2 * ones > n, axis=1).reshape(8)


def fingerprint(text: bytes, n: int = 3) -> int:
    """The signed 64-bit fingerprint of a text's ``n``-word shingles, repeats included."""
    return int(majority(shingles(ascii_words(text), n)).view(">i8")[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, n) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, print) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(n), "doc_id long, print long")


def _syndrome(point: Column) -> Column:
    """Of the (31, 26) code: the place (1 to 31) of the bit whose flip gives a code word, 0 at a code word."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)
        total = total + F.shiftleft(F.bit_count(point.bitwiseAND(F.lit(mask))) % 2, k)
    return total


def _anchored(prints: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """(slot, print) at home, and at every anchor within 1 + ``reach``; a slot is a half and a code word of it."""
    halves = F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("half"), F.shiftrightunsigned("print", 32 * h).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long").alias("point")) for h in (0, 1)))).alias("x")
    points = prints.select("print", halves).select("print", F.shiftleft("x.half", 31).alias("half"), "x.point").withColumn("s", _syndrome(F.col("point")))
    points = points.withColumn("home", F.expr("CASE WHEN s = 0 THEN point ELSE point ^ shiftleft(1L, s - 1) END"))
    homes = points.select((F.col("half") + F.col("home")).alias("slot"), "print")
    if not reach:
        return homes, homes
    far = F.expr("concat(array(home), CASE WHEN s = 0 THEN array() ELSE transform(filter(sequence(1, 31), i -> i < (i ^ s)), i -> point ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) END)")
    return homes, points.select("half", "print", F.explode(far).alias("anchor")).select((F.col("half") + F.col("anchor")).alias("slot"), "print")


def _dealt_again(rows: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Rows of hot slots once for each of ``parts`` parts of the half that the slot is not in; the others once."""
    marked = rows.join(hot, "slot", "left")
    other = F.when(F.col("slot") >= 1 << 31, F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("print", 32))
    width = -(-32 // parts)
    cut = F.array(*(F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(other, width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i in range(parts)))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value")))
    return marked.select("slot", "print", F.explode(F.when(F.col("hot"), cut).otherwise(whole)).alias("x")).select("slot", "print", "x.part", "x.value")


def linked_fingerprints(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Each pair (a, b) of distinct values of ``prints.print`` that differ in ``bits`` bits at most."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    homes, replicas = _anchored(prints.select("print").distinct(), bits // 2)
    hot = staged(homes.groupBy("slot").count().filter(F.col("count") > HOT_HOMES).select("slot", F.lit(True).alias("hot")))
    keys = ["slot"]
    if not hot.isEmpty():
        homes, replicas, keys = _dealt_again(homes, hot, bits + 1), _dealt_again(replicas, hot, bits + 1), ["slot", "part", "value"]
    pairs = homes.withColumnRenamed("print", "a").join(replicas.withColumnRenamed("print", "b"), keys)
    return pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()


def _rooted(classes: DataFrame, bits: int) -> DataFrame:
    """``classes`` (print, once each) with root, the least print reachable by links."""
    roots = components(linked_fingerprints(classes, bits)).withColumnRenamed("node", "print")
    return classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def simhash_groups(docs: DataFrame, bits: int = 2, n: int = 3) -> DataFrame:
    """doc_id, print and component_id (the least doc_id reachable by links) of each row."""
    rows = staged(fingerprints(docs, n))
    members = _rooted(staged(rows.groupBy("print").agg(F.min("doc_id").alias("least"))), bits)
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined_hot(rows, members.join(ids, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def _key(words: list[bytes]) -> int:
    """A signed 64-bit key of the words; texts that share it are one class."""
    whole = xxhash.xxh3_64_intdigest(b" ".join(words))
    return whole - (1 << 64) * (whole >> 63)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the SHINGLE_WORDS-word shingles; the whole where there are fewer words."""
    if len(words) < SHINGLE_WORDS:
        return np.array([_key(words)] if words else [], np.int64)
    hashed = np.concatenate(list(digests(words, 7))).view(">u8").reshape(-1).astype(np.uint64)
    n = len(words) - SHINGLE_WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        mixed = (mixed ^ hashed[k : k + n]) * _FACTORS[k]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingle_hashes(ascii_words(text)) for text in texts_of(batch.column(0))]
        values, n = np.unique(np.concatenate([*hashes, np.array([], np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])


def _prefixes(shipped, least: float, n: int | None):
    """The shingles that a text as similar must meet one of, by place; ``shipped`` has the common ones, sorted, and their counts.

    With ``n``, the fingerprint of the text's ``n``-word shingles, too; else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shipped.value
        for batch in batches:
            keys, prints, sizes, prefixes = [], [], [], []
            others = batch.schema.names[:-1]
            for text in texts_of(batch.column("text")):
                words = ascii_words(text)
                hashes = shingle_hashes(words)
                at = np.searchsorted(common, hashes).clip(max=len(common) - 1)
                order = np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))
                keys.append(_key(words))
                prints.append(n and int(majority(shingles(words, n)).view(">i8")[0]))
                sizes.append(len(hashes))
                prefixes.append(hashes[order[: len(hashes) - math.ceil(least * len(hashes) - ROUNDING) + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())], [*others, "key", "print", "size", "prefix"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
        if prefixes:
            row = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
            at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in prefixes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at)], ["shingle", "node", "size", "at"])


def _sets(shipped):
    """Key and packed words of the texts whose key may be among those in the filter; words pack smaller than hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for batch in batches:
            keys, packed = [], []
            for text in texts_of(batch.column(0)):
                words = ascii_words(text)
                key = _key(words)
                if int(wanted[(key % (1 << 64)) >> (64 - FILTER_WORDS)]) >> (key & 63) & 1:
                    keys.append(key)
                    packed.append(zlib.compress(b" ".join(words), 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["key", "packed"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lru_cache(256)(lambda packed: shingle_hashes(zlib.decompress(packed).split()))
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                kept = []
                for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    a, b = map(unpacked, pair)
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    kept.append(shared >= least * (len(a) + len(b) - shared) - ROUNDING)
                yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose texts have the similarity, by their whole sets of shingles."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = nodes.groupBy(F.shiftrightunsigned("key", 64 - FILTER_WORDS).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    wanted = np.zeros(1 << FILTER_WORDS, np.uint64)
    wanted[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)
    sets = staged(docs.select("text").mapInArrow(_sets(shipped), "key long, packed binary").groupBy("key").agg(F.first("packed").alias("packed")))
    left, right = (sets.select(F.col("key").alias(n), F.col("packed").alias(f"{n}_packed")).hint("merge") for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_packed", "b_packed").mapInArrow(_similar(least), "a long, b long")


def _may_be_similar(least: float) -> Column:
    """Of rows that meet at a shingle: whether sizes and what is left from there on allow the similarity."""
    left = F.least(F.col("size") - F.col("at"), F.col("other.size") - F.col("other.at"))
    enough = left >= F.lit(least / (1 + least)) * (F.col("size") + F.col("other.size")) - ROUNDING
    return (F.least("size", "other.size") >= F.lit(least) * F.greatest("size", "other.size") - ROUNDING) & enough


def _ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def _linked_keys(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): links of keys of ``rows`` (key, print) that join all keys whose fingerprints reach each other.

    Of the keys of one fingerprint each is linked to the least, and the least of two fingerprints within ``bits`` to each other."""
    keys = staged(rows.groupBy("key").agg(F.first("print").alias("print")))
    classes = staged(keys.groupBy("print").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    pairs = linked_fingerprints(classes, bits)
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("print").alias(end), F.col("least").alias(f"{end}_key")).hint("merge"), end)
    shared = joined_hot(keys, classes.filter("n > 1").select("print", F.col("least").alias("b")), "print").select(F.col("key").alias("a"), "b").filter("a <> b")
    return shared.unionByName(pairs.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def near_groups(docs: DataFrame, least: float = SIMILAR, carried: tuple[str, ...] = (), bits: int | None = None, n: int = 3) -> DataFrame:
    """doc_id, root (the key of its group) and ``carried`` columns of each row; see near_duplicates.

    With ``bits``, texts that simhash_groups links at ``bits`` and ``n`` are linked as well."""
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_repeated, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = counted.filter(F.col("n") > WINDOW).orderBy(F.desc("n"), "shingle").limit(CARRIED).toPandas().sort_values("shingle")
    shipped = context.broadcast((np.r_[common["shingle"].to_numpy(np.int64), np.iinfo(np.int64).max], np.r_[common["n"].to_numpy(np.int64), 0]))
    more = [f for f in docs.schema if f.name in carried]
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more), "key long, print long, size int, prefix binary"])
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(f.name for f in more), "text").mapInArrow(_prefixes(shipped, least, None if bits is None else n), schema))
    classes = rows.groupBy("key").agg(F.first(F.struct("size", "prefix")).alias("x")).select("key", "x.size", "x.prefix")
    listed = classes.mapInArrow(_listed, "shingle long, node long, size int, at int")
    shared = staged(listed.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).filter("n > 1").drop("n"))
    row = F.struct("node", "size", "at")
    centres = shared.groupBy("shingle").agg(*(F.min_by(row, F.xxhash64("node", F.lit(i))).alias(f"c{i}") for i in range(CENTRES)))
    centres = centres.select("shingle", F.explode(F.array(*(f"c{i}" for i in range(CENTRES)))).alias("other"))
    tried = staged(_ordered_pairs(shared.join(centres.hint("merge"), "shingle").filter(F.col("node") != F.col("other.node")).filter(_may_be_similar(least))))
    kept = _verified(docs, tried, least)
    kept = staged(kept if bits is None else kept.unionByName(_linked_keys(rows, bits)))
    release(kept)
    roots = components(kept).withColumnRenamed("root", "r")
    rooted = shared.join(roots.hint("merge"), "node", "left").withColumn("r", F.coalesce("r", "node"))
    apart = rooted.groupBy("shingle").agg(F.min("r").alias("low"), F.max("r").alias("high")).filter("low <> high").select("shingle")
    rooted = staged(rooted.join(apart.hint("merge"), "shingle"))
    others = rooted.select("shingle", F.struct("node", "size", "at", "r").alias("other")).hint("merge")
    met = rooted.join(others, "shingle").filter((F.col("node") < F.col("other.node")) & (F.col("r") != F.col("other.r"))).filter(_may_be_similar(least))
    untried = staged(_ordered_pairs(met).join(tried.hint("merge"), ["a", "b"], "left_anti"))
    release(untried)
    if not untried.isEmpty():
        found = roots.select(F.col("node").alias("a"), F.col("r").alias("b"))  # each group as a star
        roots = components(found.unionByName(_verified(docs, untried, least))).withColumnRenamed("root", "r")
    roots = roots.withColumnRenamed("node", "key")
    found = joined_hot(rows.select("doc_id", *(f.name for f in more), "key"), roots, "key", "left")
    return found.withColumn("root", F.coalesce("r", "key")).drop("key", "r")


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id and component_id of each row: documents linked by equal words or by a similarity of ``least`` or more."""
    rows = staged(near_groups(docs, least))
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return joined_hot(rows, ids, "root").select("doc_id", "component_id")
