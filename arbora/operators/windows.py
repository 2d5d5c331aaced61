"""Ordered operators: islands, stacks, ordinals, alignments in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.islands import by_key
from arbora.sources.staging import staged


def _by(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Number runs that begin where ``starts`` holds; rows before a key's first start are dropped."""
    running = F.sum(F.when(starts, 1).otherwise(0)).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, running).filter(F.col(name) > 0)


def blocks(rows: DataFrame, keys: list[str], order: list, starts: Column, ends: Column, name: str = "block") -> DataFrame:
    """Number blocks that begin with a start and stay open until a terminator; rows outside of blocks are dropped."""
    upto = _by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(starts, True).when(ends, False), ignorenulls=True).over(upto)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(upto)).withColumn("__open", opened).filter("__open").drop("__open")


def next_value(value: Column, keys: list[str], order: list) -> Column:
    """The first non-null value on a later row of the key."""
    return F.first(value, ignorenulls=True).over(_by(keys, order).rowsBetween(1, Window.unboundedFollowing))


def nearest_lower(rank: str, ranks: list[int], position: str, keys: list[str]) -> Column:
    """The position of the nearest earlier row with a lower rank: the parent that a stack of ranks would give.

    For each rank the running last position is kept, so no stack is needed: the parent is the greatest of the last positions of
    the ranks below a row's own."""
    before = _by(keys, [position]).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for r in ranks:
        last = F.max(F.when(F.col(rank) == r, F.col(position))).over(before)
        parent = F.when(F.col(rank) > r, F.greatest(F.coalesce(parent, F.lit(-1)), F.coalesce(last, F.lit(-1)))).otherwise(parent)
    return F.when(parent >= 0, parent).cast("long")


def end_pages(rows: DataFrame, keys: list[str], order: list, page: str, last: Column, name: str = "end_page") -> DataFrame:
    """A node ends a page before its next sibling starts, the last where its parent ends, never before its own page."""
    following = F.lead(page).over(_by(keys, order))
    return rows.withColumn(name, F.greatest(F.col(page), F.coalesce(following - 1, last)))


def zip_equal_groups(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """Pair the n-th rows of a group where both sides have as many rows; ``left_`` and ``right_`` prefix the columns."""

    def ranked(side: DataFrame, order: list, prefix: str) -> DataFrame:
        out = side.withColumn("__n", F.row_number().over(_by(keys, order))).withColumn("__size", F.count("*").over(Window.partitionBy(*keys)))
        return out.select(*keys, "__n", "__size", *(F.col(c).alias(prefix + c) for c in side.columns if c not in keys))

    return ranked(left, left_order, "left_").join(ranked(right, right_order, "right_"), [*keys, "__n", "__size"]).drop("__n", "__size")


def systematic_sample(rows: DataFrame, order: list, wanted: int) -> DataFrame:
    """The rows at floor(i * n / wanted) for i below ``wanted``: evenly spread, all where there are no more than wanted.

    Places are ranks within ranges of the order, added up over ranges, so that no task orders all rows; the ranges are written
    once, as another sampling of their bounds would give other ranges."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # as many rows as ranges
    before = staged(sizes.select("__part", "__n", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")))
    n = before.agg(F.sum("__n")).first()[0] or 0
    places = sorted({i * n // wanted for i in range(wanted)}) if n else []
    ranked = dealt.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before), "__part").filter((F.col("__before") + F.col("__within")).isin(places)).drop("__part", "__within", "__before", "__n")


def merged_boundaries(values: Column, tolerance: float = 2.0) -> Column:
    """Sorted values without those within ``tolerance`` of the last one kept."""
    kept = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), kept, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > tolerance), F.array_append(a, x)).otherwise(a))


def packed(rows: DataFrame, keys: list[str], order: str, weight: str, most_items: int, most_weight: int, overhead: int = 0) -> DataFrame:
    """Next-fit batches in order: a batch closes when full or when the next row would exceed the weight; ``rows`` with batch.

    Rows are numbered within their key, ties in any one order, and written; numbers and weights stream through the fold a key
    at a time, so a key's rows are the unit of memory, two numbers each. A null weight weighs nothing."""
    numbered = staged(rows.withColumn("__n", F.row_number().over(_by(keys, [order]))))
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), "__n int, batch int"])

    def fold(own: tuple, columns: dict) -> list[tuple]:
        batch, items, used, out = 0, 0, overhead, []
        for n, w in zip(columns["__n"], columns["__w"]):
            if items and (items >= most_items or used + w > most_weight):
                batch, items, used = batch + 1, 0, overhead
            items, used = items + 1, used + w
            out.append((*own, n, batch))
        return out

    light = numbered.select(*keys, "__n", F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("__w"))
    placed = by_key(light, keys, ["__n"], fold, schema)
    return numbered.join(placed, [*keys, "__n"]).drop("__n")


def apportioned(rows: DataFrame, keys: list[str], order: str, weight: str, total: str, name: str = "share") -> DataFrame:
    """Largest-remainder shares of a whole total: floors first, what is left goes to the largest remainders, ties by order.

    Zero weights throughout share equally."""
    group = Window.partitionBy(*keys)
    whole = F.sum(weight).over(group)
    exact = F.when(whole > 0, F.col(total) * F.col(weight) / whole).otherwise(F.col(total) / F.count("*").over(group))
    floored = rows.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.col(total) - F.sum("__floor").over(group)
    rank = F.row_number().over(group.orderBy(F.desc(F.col("__exact") - F.col("__floor")), order))
    return floored.withColumn("__left", left).withColumn(name, (F.col("__floor") + F.when(rank <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__exact", "__floor", "__left")


def end_pages_down(levels: list[DataFrame], last: Column) -> list[DataFrame]:
    """Levels (node, parent, page), from the top, with end_page: a node ends a page before its next sibling, the last where its parent ends."""
    out: list[DataFrame] = []
    for level in levels:
        if out:
            above = out[-1].select(F.col("node").alias("parent"), F.col("end_page").alias("__last"))
            level = level.join(above, "parent").withColumn("__end", F.col("__last")).drop("__last")
        else:
            level = level.withColumn("__end", last)
        out.append(end_pages(level, ["parent"], ["page", "node"], "page", F.col("__end")).drop("__end"))
    return out


def table_records(texts: DataFrame, key: str, text: str, heading: str, columns: list[str]) -> DataFrame:
    """(key, heading, columns) of the rows of Markdown tables below headings that a pattern's first group names.

    A heading opens a block that another line of that level ends; rows of other widths, rules and the head row are none."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("__at", "__line"))
    named = F.regexp_extract("__line", heading, 1)
    opened = blocks(lines.withColumn("__name", named), [key], ["__at"], F.col("__name") != "", F.rlike("__line", F.lit(r"^#{1,2}\s")) & (F.col("__name") == ""), "__block")
    whole = Window.partitionBy(key, "__block")
    cells = F.transform(F.split(F.regexp_replace(F.trim("__line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = opened.withColumn("heading", F.max("__name").over(whole)).filter(F.rlike(F.trim("__line"), F.lit(r"^\|.*\|$"))).withColumn("__cells", cells)
    body = rows.filter((F.size("__cells") == len(columns)) & ~F.rlike("__line", F.lit(r"^[-|: ]+$"))).withColumn("__nth", F.row_number().over(whole.orderBy("__at")))
    return body.filter("__nth > 1").select(key, "heading", *(F.get("__cells", i).alias(c) for i, c in enumerate(columns)))


def admitted(calls: DataFrame, keys: list[str], at: str, estimate: str, actual: str, seconds: str, most_calls: int, most_tokens: int, span: float = 60.0) -> DataFrame:
    """``calls`` with starts, when a limiter lets each in: in order, once fewer than ``most_calls`` and tokens enough are left in the last ``span`` seconds.

    A call counts with its estimate while it runs (``seconds``), with its actual tokens from then on; one beyond the whole budget
    goes alone. The limiter's state runs from call to call, so a key is the unit; it holds the calls of one span."""
    numbered = staged(calls.withColumn("__n", F.row_number().over(_by(keys, [at]))))
    schema = ", ".join([*(f"`{k}` {dict(calls.dtypes)[k]}" for k in keys), "__n int, starts double"])

    def fold(own: tuple, columns: dict) -> list[tuple]:
        inside, now, out = [], 0.0, []
        for n, arrives, guess, used, took in zip(*(columns[x] for x in ("__n", "__at", "__e", "__a", "__s"))):
            now = max(now, arrives)
            while True:
                inside = [x for x in inside if now - x[0] < span]
                spent = sum(x[2] if now >= x[0] + x[3] else x[1] for x in inside)
                if not inside or (len(inside) < most_calls and spent + guess <= most_tokens):
                    break
                now = inside[0][0] + span
            inside.append((now, guess, used, took))
            out.append((*own, n, now))
        return out

    light = numbered.select(*keys, "__n", F.col(at).cast("double").alias("__at"), F.col(estimate).cast("long").alias("__e"), F.col(actual).cast("long").alias("__a"), F.col(seconds).cast("double").alias("__s"))
    return numbered.join(by_key(light, keys, ["__n"], fold, schema), [*keys, "__n"]).drop("__n")
