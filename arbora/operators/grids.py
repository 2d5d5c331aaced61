"""Table grids from the rules that are drawn on a page, and the text in their cells.

Rules are boxes (page, x0, y0, x1, y1), anchors (id, page, below, above) say where a table is looked for: from ``below`` down to
``above``, the foot of the page where that is null. Everything is grouped by anchor, so pages are never gathered. Rules
and grids meet by sort and merge: Spark takes a table of few columns, and rules made by an explode, for far smaller than they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.boxes import SAME_EDGE, band_index, in_band, is_row_rule, rule_kind
from arbora.operators.windows import merged_boundaries

#: A grid has this many rows and columns at least.
LEAST_ROWS, LEAST_COLUMNS = 1, 2


def grids(anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """``anchors`` with col_xs and row_ys, the merged edges of columns and rows; anchors without a grid are left out.

    Columns come from the vertical rules in the band, rows from the horizontal ones that run from column edge to column edge."""
    box = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    drawn = rules.withColumn("kind", rule_kind(box)).filter("kind IS NOT NULL")
    near = anchors.join(drawn.hint("merge"), "page").filter(in_band(F.col("y0"), F.col("below"), F.col("above")))
    upright = F.when(F.col("kind") == "vertical", (F.col("x0") + F.col("x1")) / 2)
    level = F.when(F.col("kind") == "horizontal", F.struct("x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("mid")))
    drawn_by = near.groupBy("id").agg(merged_boundaries(F.collect_list(upright)).alias("col_xs"), F.collect_list(level).alias("__level"))
    across = F.filter("__level", lambda r: is_row_rule(r["x0"], r["x1"], F.col("col_xs")))
    edged = drawn_by.select("id", "col_xs", merged_boundaries(F.transform(across, lambda r: r["mid"])).alias("row_ys"))
    found = anchors.join(edged.hint("merge"), "id")
    return found.filter((F.size("row_ys") > LEAST_ROWS) & (F.size("col_xs") > LEAST_COLUMNS))


def through_columns(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, x) of the column edges whose rules run the whole height of the grid."""
    box = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    upright = rules.filter(rule_kind(box) == "vertical").select("page", ((F.col("x0") + F.col("x1")) / 2).alias("mid"), "y0", "y1")
    edges = found.select("id", "page", "col_xs", F.get("row_ys", 0).alias("top"), F.element_at("row_ys", -1).alias("foot"))
    near = F.filter("col_xs", lambda x: F.abs(F.col("mid") - x) <= SAME_EDGE)
    met = edges.join(upright.hint("merge"), "page").select("id", "top", "foot", "y0", "y1", F.explode(near).alias("x")).groupBy("id", "x", "top", "foot").agg(F.min("y0").alias("from"), F.max("y1").alias("to"))
    return met.filter((F.col("from") <= F.col("top") + SAME_EDGE) & (F.col("to") >= F.col("foot") - SAME_EDGE)).select("id", "x")


def filed_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(id, row, col, text, x0, y0, x1, y1): what stands in each cell, lines (page, text, x0, y0, x1, y1) from top to bottom, one space between, and its box.

    A line belongs to the row of its middle and to the column it starts in."""
    placed = lines.join(found.hint("merge"), "page").withColumn("row", band_index((F.col("y0") + F.col("y1")) / 2, F.col("row_ys"))).withColumn("col", band_index(F.col("x0"), F.col("col_xs")))
    cells = placed.filter("row IS NOT NULL AND col IS NOT NULL").groupBy("id", "row", "col")
    piece = F.struct("y0", "x0", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), " ")
    return cells.agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def consumed_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines whose middle lies in a grid of their page: the page walk passes over them."""
    inside = lambda mid, edges: (mid >= F.get(edges, 0)) & (mid <= F.element_at(edges, -1))
    outer = found.select("page", "col_xs", "row_ys")
    met = (F.col("l.page") == F.col("g.page")) & inside((F.col("x0") + F.col("x1")) / 2, F.col("col_xs")) & inside((F.col("y0") + F.col("y1")) / 2, F.col("row_ys"))
    return lines.alias("l").join(outer.alias("g").hint("merge"), met, "left_semi")


def split_at(text: Column, x0: Column, x1: Column, edges: Column) -> Column:
    """(band, text) pieces of a line's words by the edges that run through it, x being spread evenly over its characters.

    Words of one band that follow each other are one piece."""
    width = (x1 - x0) / F.greatest(F.length(text), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<band:int,text:string>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        at = F.instr(F.substr(text, a["at"] + 1, F.length(text)), w) + a["at"] - 1
        middle = x0 + width * (at + F.length(w) / 2)
        band = F.size(F.filter(edges, lambda e: e <= middle)).cast("int")
        last = F.try_element_at(a["out"], F.lit(-1))
        same = (F.size(a["out"]) > 0) & (last["band"] == band)
        grown = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(band.alias("band"), F.concat(last["text"], F.lit(" "), w).alias("text"))))
        out = F.when(same, grown).otherwise(F.array_append(a["out"], F.struct(band.alias("band"), w.alias("text"))))
        return F.struct((at + F.length(w)).cast("int").alias("at"), out.alias("out"))

    return F.aggregate(words, start, step)["out"]
