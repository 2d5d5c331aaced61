"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII. A window is ``span`` consecutive
words of an item; a shorter item is one window. A window's elements are its shingles of SHINGLE words (a window that is shorter
has one element, itself). Where a document holds a window it holds all of its elements, so the prefix that must meet is one
element: the rarest over all documents.

Each text is cut into words once. Its shingles' hashes meet those of the benchmark's elements; what meets, a small table, is
written with place and words. Counts of it order the elements by rarity, meetings at prefix elements give the places where a
window may start, bounded by the words before and after, and each place is verified word by word: the elements that cover the
window edge to edge must stand at their places, compared as text. Texts are neither read again nor shuffled.

What comes of the benchmark alone (hashes of elements, prefixes, covering elements, items) is broadcast where it has at most
BROADCAST_ELEMENTS elements, so that rows of a passage that very many documents hold stay where they are; beyond that both sides
are shuffled.

Defined cases: null has no words; a text or item without words has no hit; repeated items are items, repeated ids one; rows
with equal id and text are judged alike; items with a null id count under the empty id; empty tables give no hit; further
columns are ignored by ``hits`` and pass through ``decontaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import row_keys, staged

SPAN = 10
SHINGLE = 5
BROADCAST_ELEMENTS = 500_000
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = ["k1", "k2"]


def words_of(text: str) -> Column:
    """The words of a text column, without a null. Texts of ASCII alone take the fast lower(), which changes letters beyond ASCII."""
    whole = F.coalesce(F.col(text), F.lit(""))
    small = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def _run(words: str, at: Column, n: int) -> list[Column]:
    return [F.get(words, at + k) for k in range(n)]


def _shingles(rows: DataFrame, sizes: list[int], *kept: str) -> DataFrame:
    """``kept``, at, element (a hash) and words of each run of ``sizes`` words; expressions over an exploded place stay compiled."""
    places = rows.select(*kept, "words", F.posexplode("words").alias("at", "__word"))
    parts = [places.filter(F.col("at") <= F.size("words") - n).select(*kept, "words", "at", F.lit(n).alias("n"), F.xxhash64(*_run("words", F.col("at"), n)).alias("element")) for n in sizes]
    return reduce(DataFrame.unionByName, parts)


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """One row a distinct window: text, words, length, items (sorted ids as strings)."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - span + 1))
    cut = worded.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, span))).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.array_join("words", " ").alias("text"), "words", F.size("words").alias("length"), "items")


def window_elements(cut: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(text, length, offset, element, shingle) of each window's elements."""
    sizes = [(F.col("length") >= shingle, shingle), *((F.col("length") == n, n) for n in range(1, shingle))]
    parts = [_shingles(cut.filter(fits), [n], "text", "length") for fits, n in sizes]
    every = reduce(DataFrame.unionByName, parts)
    return every.select("text", "length", F.col("at").alias("offset"), "element", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("shingle"))


def _is_small(elements: DataFrame) -> bool:
    return elements.count() <= BROADCAST_ELEMENTS


def _met(rows: DataFrame, elements: DataFrame, shingle: int) -> DataFrame:
    """Row keys, at and shingle wherever a row has an element of ``elements``; also one line a row with n_words, without shingle."""
    sizes = sorted({min(r[0], shingle) for r in elements.select("length").distinct().collect()})
    known = elements.select("element").distinct()
    small = _is_small(elements)
    worded = rows.withColumn("words", words_of("text")).drop("text")
    names = [c for c in worded.columns if c not in (*ROW, "words")]
    heads = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in names]
    places = worded.select(*ROW, *names, "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "__word"))
    runs = [F.when(F.col("at") <= F.size("words") - n, F.xxhash64(*_run("words", F.col("at"), n))) for n in sizes]
    if len(runs) == 1:
        places = places.withColumn("n", F.lit(sizes[0])).withColumn("run", runs[0])
    elif runs:
        places = places.withColumn("x", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), r.alias("run")) for n, r in zip(sizes, runs))))).select("*", "x.n", "x.run").drop("x")
    else:
        places = places.withColumn("n", F.lit(0)).withColumn("run", F.lit(None).cast("long"))
    first = (F.col("at") == 0) & (F.col("n") == (sizes[0] if sizes else 0))
    words = F.when(F.col("element").isNotNull(), F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")).alias("shingle")
    n_words = F.when(first, F.size("words").cast("long")).alias("n_words")
    if small:
        return places.join(F.broadcast(known), F.col("run") == F.col("element"), "left").filter(first | F.col("element").isNotNull()).select(*ROW, *heads, n_words, "at", words)
    line = places.filter(first).select(*ROW, *heads, n_words, "at", F.lit(None).cast("string").alias("shingle"))
    runs = places.filter("run IS NOT NULL").select(*ROW, "at", "run", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("shingle"))
    held = runs.join(known.hint("merge"), F.col("run") == F.col("element")).select(*ROW, "at", "shingle")
    return line.unionByName(held, allowMissingColumns=True)


def occurrences(met: DataFrame, elements: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Row keys, start, length and text of each place in ``met`` where a whole window stands."""
    ready = F.broadcast if _is_small(elements) else (lambda df: df)
    found = met.filter("shingle IS NOT NULL").select(*ROW, "at", "shingle")
    counted = found.groupBy("shingle").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("text").orderBy(F.coalesce("n", F.lit(0)), "offset"))
    prefix = elements.join(counted, "shingle", "left").withColumn("nth", nth).filter("nth = 1 AND n > 0").select("shingle", "offset", "text", "length")
    maybe = found.join(ready(prefix), "shingle").filter(F.col("at") >= F.col("offset")).select(*ROW, (F.col("at") - F.col("offset")).alias("start"), "text", "length").distinct()
    edge = F.greatest(F.col("length") - shingle, F.lit(0))
    covering = elements.filter((F.col("offset") % shingle == 0) | (F.col("offset") == edge)).select("text", "offset", "shingle")
    asked = maybe.join(ready(covering), "text").withColumn("at", F.col("start") + F.col("offset"))
    held = asked.join(found.distinct().hint("merge"), [*ROW, "at", "shingle"])
    whole = held.groupBy(*ROW, "start", "length", "text").agg(F.count("*").alias("n"))
    needed = covering.groupBy("text").agg(F.count("*").alias("n"))
    return whole.join(ready(needed), ["text", "n"]).select(*ROW, "start", "length", "text")


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit and items (sorted ids of items with an occurring window) of each row, and its key."""
    cut = staged(windows(items, span))
    elements = staged(window_elements(cut))
    keys = [k.alias(n) for k, n in zip(row_keys("doc_id", "text"), ROW)]
    met = staged(_met(docs.select(*keys, "doc_id", "text"), elements, SHINGLE))
    sure = staged(occurrences(met, elements))
    # words that no earlier occurrence of the row covers, in order of start
    earlier = Window.partitionBy(*ROW).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ends = sure.select(*ROW, "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    n_hit = ends.withColumn("fresh", fresh).groupBy(*ROW).agg(F.sum("fresh").alias("n_hit"))
    listed = cut.select("text", F.explode("items").alias("item"))
    listed = F.broadcast(listed) if listed.count() <= BROADCAST_ELEMENTS else listed
    named = sure.select(*ROW, "text").distinct().join(listed, "text").select(*ROW, "item").distinct()
    named = named.groupBy(*ROW).agg(F.sort_array(F.collect_list("item")).alias("items"))
    lines = met.filter("n_words IS NOT NULL").select(*ROW, "doc_id", "n_words")
    judged = lines.join(n_hit.join(named, ROW).hint("merge"), ROW, "left")  # contaminated documents have no bound, so never broadcast
    return judged.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *ROW)


def decontaminated(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    bad = hits(docs.select("doc_id", "text"), items, span).filter("n_hit > 0").select(*(F.col(k).alias(f"__{k}") for k in ROW)).distinct()
    mine = row_keys("doc_id", "text")
    return docs.join(bad.hint("merge"), (mine[0] == F.col("__k1")) & (mine[1] == F.col("__k2")), "left_anti")
