"""Positioned text: lines from spans, styles over parts of a text, captions' owners, titles carried on, tables carried over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.records import style_name

#: Fixed value: how far from the middle of its page a centred line may lie.
CENTRE_TOLERANCE = 20.0
RANGES = "array<struct<s:int,e:int,style:string>>"


def assembled_lines(spans: DataFrame, keys: list[str], order: str, width: Column) -> DataFrame:
    """A row a line from spans (keys, order, text, font, bold, italic, x0, y0, x1, y1): text, font, emphasis, box, centred.

    Blank spans go, and a line of none but blank ones with them; the text loses the space at its ends; fonts are a sorted set; touching spans
    of one style are one range."""
    worded = spans.filter(F.trim("text") != "")
    span = F.struct(order, "text", style_name(F.col("bold"), F.col("italic")).alias("style"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = worded.groupBy(*keys).agg(F.sort_array(F.collect_list(span)).alias("xs"), F.array_join(F.sort_array(F.collect_set("font")), "/").alias("font"), *box)
    whole = F.array_join(F.transform("xs", lambda x: x["text"]), "")
    lead = F.length(whole) - F.length(F.ltrim(whole))
    start = F.struct((-lead).cast("int").alias("at"), F.array().cast(RANGES).alias("out"))
    walked = F.aggregate("xs", start, lambda a, x: F.struct((a["at"] + F.length(x["text"])).cast("int").alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("s"), (a["at"] + F.length(x["text"])).cast("int").alias("e"), x["style"].alias("style"))).alias("out")))
    text = F.trim(whole)
    emphasis = merged_ranges(clipped_ranges(walked["out"], F.lit(0), F.length(text)))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= CENTRE_TOLERANCE
    return lines.select(*keys, text.alias("text"), "font", emphasis.alias("emphasis"), "x0", "y0", "x1", "y1", centred.alias("centred"))


def numbered_lines(lines: DataFrame, page: str) -> DataFrame:
    """``lines`` with line_no, their rank on the page from top to bottom and left to right."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(page).orderBy("y0", "x0", "text")))


def clipped_ranges(ranges: Column, start: Column, end: Column) -> Column:
    """Styled ranges cut to [start, end), plain and empty ones left out."""
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(r["s"], start).cast("int").alias("s"), F.least(r["e"], end).cast("int").alias("e"), r["style"].alias("style")))
    return F.filter(cut, lambda r: (r["e"] > r["s"]) & (r["style"] != ""))


def merged_ranges(ranges: Column) -> Column:
    """Sorted ranges with touching ones of one style made one."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, r: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["s"].alias("s"), r["e"].alias("e"), r["style"].alias("style"))))
    touches = lambda a, r: (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] == r["s"]) & (F.try_element_at(a, F.lit(-1))["style"] == r["style"])
    return F.aggregate(F.array_sort(ranges), F.array().cast(RANGES), lambda a, r: F.when(touches(a, r), grown(a, r)).otherwise(F.array_append(a, r)))


def shifted_ranges(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda r: F.struct((r["s"] + by).cast("int").alias("s"), (r["e"] + by).cast("int").alias("e"), r["style"].alias("style")))


def sliced(text: Column, ranges: Column, start: Column, end: Column) -> Column:
    """Part [start, end) of a styled text, space at its front left out, its ranges counted from there."""
    part = F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
    first = start + F.length(part) - F.length(F.ltrim(part))
    return F.struct(F.ltrim(part).alias("text"), shifted_ranges(clipped_ranges(ranges, first, end), -first).alias("emphasis"))


def joined_texts(left: Column, left_ranges: Column, right: Column, right_ranges: Column) -> Column:
    """Two styled texts with one space between; an empty one adds none."""
    offset = F.when(left == "", 0).otherwise(F.length(left) + 1)
    text = F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.lit(" "), right))
    return F.struct(text.alias("text"), merged_ranges(F.concat(left_ranges, shifted_ranges(right_ranges, offset))).alias("emphasis"))


def caption_owners(lines: DataFrame, keys: list[str], order: str, opens: Column, is_caption: Column, citation: Column) -> DataFrame:
    """Captions among ``lines`` with owner, the citation of the last line before that opened a node; null before the first."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("owner", F.last(F.when(opens, citation), ignorenulls=True).over(before)).filter(is_caption)


def carried_titles(lines: DataFrame, keys: list[str], order: str, opens: Column, carries: Column, text: Column, most: int) -> DataFrame:
    """Opening lines with title: their text and that of up to ``most`` lines right behind that ``carries`` holds for, in order."""
    walk = Window.partitionBy(*keys).orderBy(order)
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__o", opens).withColumn("__c", carries & ~F.col("__o")).withColumn("__t", text)
    marked = marked.withColumn("__group", F.sum(F.col("__o").cast("int")).over(upto)).filter("__group > 0")
    inside = Window.partitionBy(*keys, "__group").orderBy(order)
    broken = F.sum((~F.col("__o") & ~F.col("__c")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    kept = marked.withColumn("__n", F.row_number().over(inside) - 1).withColumn("__broken", broken).filter((F.col("__broken") == 0) & (F.col("__n") <= most))
    piece = F.struct("__n", F.trim("__t").alias("t"))
    titles = kept.groupBy(*keys, "__group").agg(F.min(order).alias(order), F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["t"]), " ").alias("title"))
    return titles.drop("__group")


def stitched_regions(regions: DataFrame, key: str) -> DataFrame:
    """Regions (key, page, open, x0, x1, rows) with first_page and row_start: one table where a key's region on the next page carries on.

    A region carries on what stands right before it of its key if that has no bottom border (open), lies a page earlier and
    has the same sides within two points; rows go on counting."""
    walk = Window.partitionBy(key).orderBy("page")
    same = (F.lag("page").over(walk) == F.col("page") - 1) & F.lag("open").over(walk) & (F.abs(F.lag("x0").over(walk) - F.col("x0")) <= 2) & (F.abs(F.lag("x1").over(walk) - F.col("x1")) <= 2)
    grouped = regions.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__table", F.sum("__new").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "__table").orderBy("page")
    start = F.coalesce(F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("first_page", F.first("page").over(inside)).withColumn("row_start", start).drop("__new", "__table")


def first_below(anchors: DataFrame, lines: DataFrame, key: str, holds: Column) -> DataFrame:
    """``anchors`` (key, page, top, bound) with found, the text of the first line (page, y0, text) under each, above its bound, that ``holds``."""
    inside = (F.col("a.page") == F.col("l.page")) & (F.col("y0") > F.col("top")) & (F.col("bound").isNull() | (F.col("y0") < F.col("bound")))
    met = anchors.alias("a").join(lines.filter(holds).alias("l"), inside).groupBy(F.col(f"a.{key}").alias(key)).agg(F.min_by("l.text", F.struct("y0", "l.text")).alias("found"))
    return anchors.join(met, key, "left")


def selected(rows: DataFrame, name: str, only: list[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows named in ``only``, all where it is empty; then the first ``limit`` in order, where one is given."""
    kept = rows.filter(F.col(name).isin(only)) if only else rows
    return kept if limit is None else kept.orderBy(order or name).limit(limit)
