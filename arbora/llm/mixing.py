"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: weights 5, 2, 1, repeating over the sources in code-point order (null last), share ``share`` times all words; a target
stops at ``most`` times its source's words and the excess is shared again by weight, until none is above. The level
that all open targets share per weight is found by repeated sums over the table of sources.

Schedule: golden-ratio points walk through the cumulative targets, so that every stretch of the schedule holds the sources in
proportion, and slots are ranked within their source. A source's documents, shuffled by a hash, lie end to end on a line of
words that is walked twice and cut into blocks of ``block_words``. The blocks are shuffled by the same sequence (block b stands
where the b-th point lies, those of the first walk first), and the slot of rank r takes the r-th of them. So the sequence
decides both when a source is read and which of its blocks are. The last slot of a source takes the words that are left to
its target; slots beyond that go, and slots that the sequence leaves a source short of follow at the end. What a document gives
is the words it shares with the blocks that slots took, and its place is the first slot that took any.

Ranks and positions on hot sources come from counts of ranges and buckets plus ranks within them, so no task gathers a source;
sources are ranked by ranges too, so their number is not bound.

Defined cases: null or empty texts have size 0 and give nothing; null sources are one source, the last; repeated rows are
documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import numbered, row_key, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 2048
BUCKET_ROWS = 2048
BUCKET_BLOCKS = 1 << 16
CHUNK_SLOTS = 1 << 16
CELLS = 4096
BROADCAST_SOURCES = 100_000
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a key that shuffles the rows."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), row_key("doc_id", "text").alias("order"))


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, k (its rank), source_size, weight, target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(totals, [F.col("source").asc_nulls_last()], "k")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = staged(ordered.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size")))
    total = SHARE * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # sources stop one after another as the level rises; sums of whole numbers are exact in any order
        over = F.col("cap") < F.lit(level) * F.col("weight")
        full, open_, now = weighed.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if now == stopped or not open_:
            break
        stopped, level = now, (total - full) / open_
    return weighed.select("source", "k", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def point(n: Column) -> Column:
    """The n-th point of the sequence, in [0, 1)."""
    return (n * F.lit(GOLDEN)) % 1.0


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, k, rank): the source of each slot and the slot's rank within its source. ``goals`` has k, target and needed slots."""
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = math.ceil(total / block_words)
    spans = staged(numbered(goals.filter("target > 0").select("k", "target", "needed"), [F.col("k")], "nth"))
    shares = spans.repartitionByRange("nth").select("k", "nth", "target").withColumn("part", F.spark_partition_id())
    shares = staged(shares)
    upto = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    before = shares.groupBy("part").agg(F.sum("target").alias("n"))  # as many rows as partitions
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    edges = shares.withColumn("high", F.sum("target").over(upto)).join(F.broadcast(before), "part")
    edges = edges.select("k", "nth", ((F.col("before") + F.col("high") - F.col("target")) / total).alias("low"), ((F.col("before") + F.col("high")) / total).alias("high")) if total else edges.select("k", "nth", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    last = spans.count() - 1
    edges = edges.withColumn("low", F.when(F.col("nth") == 0, -1.0).otherwise(F.col("low"))).withColumn("high", F.when(F.col("nth") == last, 2.0).otherwise(F.col("high")))
    cell = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))) * CELLS)
    cells = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = goals.sparkSession.range(1, slots + 1).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    placed = points.join(cells, "cell").filter("point >= low and point < high").select("slot", "k", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    counted = placed.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("k", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("inside", inside).join(before, ["k", "chunk"]).select("slot", "k", (F.col("before") + F.col("inside")).alias("rank"))
    given = counted.groupBy("k").agg(F.sum("n").alias("given"))
    short = spans.join(given, "k", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < needed")
    added = short.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)))
    added = added.select((F.lit(slots + 1) + F.col("rank") - F.col("given")).cast("long").alias("slot"), "k", F.col("rank").cast("long"))
    return ranked.unionByName(added)


def blocks(figures: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(k, block, slot, words): the slot that takes a block of a source's line, and how many of its first words."""
    each = figures.filter("needed > 0").withColumn("whole", F.expr(f"CAST({MOST} * source_size AS BIGINT) div {block_words}"))
    # of needed blocks in a line of few more, all have their place in the shuffle
    line = each.withColumn("block", F.explode(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))))
    again = (F.col("block") * block_words >= F.col("source_size")).cast("double")
    line = line.select("k", "block", "whole", (again + point(F.col("block") + 1)).alias("place")).withColumn("bucket", F.floor(F.col("place") * F.ceil(F.col("whole") / BUCKET_BLOCKS)))
    line = staged(line)
    counted = line.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = counted.select("k", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("place", "block")) - 1
    ranked = line.withColumn("inside", inside).join(before, ["k", "bucket"]).select("k", "block", (F.col("before") + F.col("inside")).alias("rank"))
    rest = each.select("k", F.col("whole").alias("block"), F.col("whole").alias("rank"))  # what no whole block covers comes last
    taken = ranked.unionByName(rest).join(slots, ["k", "rank"]).join(each.select("k", "goal", "needed"), "k").filter("rank < needed")
    return taken.select("k", "block", "slot", F.least(F.lit(block_words), F.col("goal") - F.col("rank") * block_words).alias("words"))


def lines(sized: DataFrame, figures: DataFrame) -> DataFrame:
    """Each row with its source's figures and ``at``, the words before it on its source's line."""
    rows = sized.count()
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    renamed = figures.withColumnRenamed("source", "__source")
    renamed = F.broadcast(renamed) if renamed.count() <= BROADCAST_SOURCES else renamed
    dealt = sized.join(renamed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("bucket", F.pmod("order", F.lit(buckets)))
    totals = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select("k", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("k", "bucket").orderBy("order", "doc_id", "size")
    placed = dealt.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(before, ["k", "bucket"]).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot (null if nothing is taken) for each row of ``docs``."""
    sized = staged(sizes(docs))
    goals = targets(sized).withColumn("goal", F.round("target").cast("long")).withColumn("needed", F.ceil(F.col("goal") / block_words))
    figures = staged(goals)
    chosen = staged(blocks(figures, staged(schedule(figures, block_words)), block_words))
    placed = lines(sized, figures.select("source", "k", "source_size", "target"))
    walks = placed.withColumn("begin", F.explode(F.array(F.col("at"), F.col("source_size") + F.col("at")))).withColumn("end", F.col("begin") + F.col("size"))
    own = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}")))
    pieces = walks.withColumn("block", F.explode_outer(own))
    joined = pieces.join(chosen, ["k", "block"], "left")
    start = F.col("block") * block_words
    shared = F.greatest(F.lit(0), F.least("end", start + F.col("words")) - F.greatest("begin", start))
    given = F.when(F.col("words").isNotNull(), shared).otherwise(F.lit(0))
    summed = joined.groupBy("k", "bucket", "nth", "doc_id", "source", "size", "source_size", "target").agg(F.sum(given).alias("taken"), F.min(F.when(given > 0, F.col("slot"))).alias("first_slot"))
    return summed.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")
