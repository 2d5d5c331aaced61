"""Positioned text, styles, carried tables and publishing on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.records import shows_formula_error
from arbora.operators import grids, pages
from arbora.sources import files
from arbora.sources.tables import table

c = F.col


def _string(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def assembled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as spans of one line of text: text, fonts, runs of style, box, and whether it is centred."""
    spans = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    text = F.when(c("l_linenumber") == 3, "  ").otherwise(_string(" w", c("p")))
    spans = spans.select(c("l_orderkey").alias("line"), c("l_linenumber").alias("n"), text.alias("text"), F.when(c("l_linenumber") % 2 == 0, "B").otherwise("A").alias("font"), (c("l_linenumber") < 3).alias("bold"), F.lit(False).alias("italic"), c("q").alias("x0"), F.lit(1.0).alias("y0"), (c("q") + 5).alias("x1"), F.lit(2.0).alias("y1"))
    lines = pages.assembled_lines(spans, ["line"], "n", F.lit(60.0))
    shown = F.array_join(F.transform("emphasis", lambda r: F.concat_ws(":", r["s"].cast("string"), r["e"].cast("string"), r["style"])), ",")
    return lines.select("line", "text", "font", shown.alias("emphasis"), "x0", "x1", "centred")


def caption_owners(spark: SparkSession, d: str) -> DataFrame:
    """Error events as captions, owned by the last sign-up or purchase of their user before."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    owned = pages.caption_owners(rows, ["user_id"], "event_id", c("event_type").isin("signup", "purchase"), c("event_type") == "error", _string("E", c("event_id")))
    return owned.select("event_id", "owner")


def carried_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that open with a purchase and carry on over up to two views or clicks right behind."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return pages.carried_titles(rows, ["user_id"], "event_id", c("event_type") == "purchase", c("event_type").isin("view", "click"), _string(c("event_type"), c("event_id")), 2).select("user_id", "event_id", "title")


def style_slices(spark: SparkSession, d: str) -> DataFrame:
    """The second half of part names, bold from their third character on, joined to their brand in italics."""
    n = F.length("p_name")
    ranges = F.array(F.struct(F.lit(2).alias("s"), n.cast("int").alias("e"), F.lit("b").alias("style")))
    cut = pages.sliced(c("p_name"), ranges, F.floor(n / 2).cast("int"), n)
    brand = F.array(F.struct(F.lit(0).alias("s"), F.length("p_brand").cast("int").alias("e"), F.lit("i").alias("style")))
    rows = table(spark, d, "part").withColumn("cut", cut)
    joined = pages.joined_texts(c("cut.text"), c("cut.emphasis"), c("p_brand"), brand)
    shown = F.array_join(F.transform(joined["emphasis"], lambda r: F.concat_ws(":", r["s"].cast("string"), r["e"].cast("string"), r["style"])), ",")
    return rows.select("p_partkey", joined["text"].alias("text"), shown.alias("emphasis"))


def stitched_regions(spark: SparkSession, d: str) -> DataFrame:
    """Months of customers as regions of one table, carried on while none is missing and the last was open."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    regions = table(spark, d, "orders").groupBy("o_custkey", month.alias("page")).agg((F.max("o_orderstatus") != "P").alias("open"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"), F.count("*").alias("rows"))
    return pages.stitched_regions(regions, "o_custkey").select("o_custkey", "page", "first_page", c("row_start").cast("long").alias("row_start"))


def forming_parts(spark: SparkSession, d: str) -> DataFrame:
    """Of each returned line the first line of its order further down, above a bound, that is a formula error's twin."""
    rows = table(spark, d, "lineitem")
    anchors = rows.filter("l_returnflag = 'R'").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), c("l_orderkey").alias("page"), c("l_quantity").alias("top"), F.when(c("l_linenumber") % 2 == 0, c("l_quantity") + 10).alias("bound")).distinct()
    lines = rows.select(c("l_orderkey").alias("page"), c("l_quantity").alias("y0"), F.when(c("l_linenumber") % 3 == 0, _string("plain", c("l_partkey"))).otherwise(_string("[f] ", c("l_partkey"))).alias("text"))
    return pages.first_below(anchors, lines, "id", shows_formula_error(c("text"))).select("id", "found")


def pruned_index(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as an index shows them: titles of two types, contents of one, unset fields left out of the JSON."""
    kept = {"ECONOMY": ("title",), "PROMO": ("title", "content")}
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(F.lit("ECONOMY"), F.lit("PROMO"), F.lit("OTHER")), (c("p_size") % 3 + 1).cast("int")).alias("type"), c("p_name").alias("title"), F.when(c("p_partkey") % 4 == 0, "").otherwise(c("p_brand")).alias("content"))
    out = files.pruned(rows, "type", kept, ("title", "content"))
    return out.select("p_partkey", F.to_json(F.struct("type", "title", "content")).alias("json"))


def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nations as epics and customers as their stories, where some were created before."""
    parents = table(spark, d, "nation").select(_string("N", c("n_nationkey")).alias("key"))
    children = table(spark, d, "customer").select(_string("C", c("c_custkey")).alias("key"), _string("N", c("c_nationkey")).alias("parent"))
    made = parents.filter(F.substr("key", F.lit(2), F.lit(9)).cast("int") < 10).unionByName(children.filter("parent = 'N3'").select("key"))
    return files.to_publish(parents, children, made.withColumn("id", F.concat(F.lit("K-"), "key")))


def file_report(spark: SparkSession, d: str) -> DataFrame:
    """Customers' and suppliers' nations as files of two folders, reported with a score."""
    left = table(spark, d, "customer").filter("c_nationkey < 15").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    right = table(spark, d, "supplier").filter("s_nationkey > 5").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    pairs = left.join(right, "k", "full_outer").select(_string(c("k")).alias("stem"), F.when(c("n").isNotNull(), _string(c("k"), ".png")).alias("left"), F.when(c("m").isNotNull(), _string(c("k"), ".jpg")).alias("right"), (F.lit(100.0) - c("k")).alias("score"))
    return files.report_lines(pairs).select("line")


def read_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings read from texts made of parts."""
    text = F.concat(F.lit("# made\nexport NAME='"), "p_name", F.lit("'\nSIZE = "), c("p_size").cast("string"), F.lit("\nodd line\nSIZE=\"9"), c("p_size").cast("string"), F.lit('"\n'))
    found = files.settings(text)
    return table(spark, d, "part").select("p_partkey", found["NAME"].alias("name"), found["SIZE"].alias("size"), F.size(found).cast("long").alias("n"))


def _ruled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as pages with a grid of three columns and two rows, an underline inside a cell, and lines of text."""
    pages_of = table(spark, d, "orders").select(c("o_orderkey").alias("page"))
    rule = lambda *b: F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)))
    drawn = F.array(rule(0, 0, 1, 40), rule(50, 0, 51, 40), rule(50.5, 0, 51.5, 40), rule(80, 0, 81, 20), rule(100, 0, 101, 40), rule(0, 0, 100, 1), rule(0, 20, 100, 21), rule(0, 40, 100, 41), rule(10, 30, 20, 31), rule(0, 90, 100, 91))
    rules = pages_of.select("page", F.explode(drawn).alias("r")).select("page", "r.*")
    anchors = pages_of.select(c("page").cast("string").alias("id"), "page", F.lit(0.0).alias("below"), F.when(c("page") % 2 == 0, 60.0).alias("above"))
    x, y = c("l_quantity") * 2 + 0.25, c("l_linenumber") * 7.0 - 6
    lines = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("page"), "l_linenumber").agg(F.min("l_quantity").alias("l_quantity")).select("page", _string("n", c("l_linenumber")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 2).alias("y1"))
    return anchors, rules, lines


def ruled_cells(spark: SparkSession, d: str) -> DataFrame:
    """The text of the cells of ruled grids."""
    anchors, rules, lines = _ruled(spark, d)
    return grids.filed_lines(lines, grids.grids(anchors, rules)).select("id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), "text")


def through_columns(spark: SparkSession, d: str) -> DataFrame:
    """Column edges that run through the whole of a ruled grid."""
    anchors, rules, _ = _ruled(spark, d)
    return grids.through_columns(grids.grids(anchors, rules), rules).groupBy("id").agg(F.count("*").alias("n"), F.max("x").alias("last"))


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two numbers cut at the column edge between them."""
    pieces = grids.split_at(_string(c("p_size"), "    ", c("p_partkey")), F.lit(0.0), F.lit(100.0), F.array(F.lit(45.0)))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(pieces, lambda p: F.concat_ws(":", p["band"].cast("string"), p["text"])), "|").alias("pieces"))


QUERIES = {f.__name__: f for f in (ruled_cells, through_columns, split_lines, assembled_lines, caption_owners, carried_titles, style_slices, stitched_regions, forming_parts, pruned_index, publish_plan, file_report, read_settings)}

ORACLES = {
    "ruled_cells": """
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_quantity) * 2 + 0.25::DOUBLE AS x, l_linenumber * 7.0::DOUBLE - 6 AS y FROM lineitem GROUP BY 1, 2),
k AS (SELECT page, n, y, x, CASE WHEN page % 2 = 0 THEN 40.5 ELSE 90.5 END AS foot FROM l),
b AS (SELECT page::VARCHAR AS id, n, x, y, CASE WHEN y + 1 < 0.5 OR y + 1 >= foot THEN NULL WHEN y + 1 < 20.5 THEN 0 WHEN y + 1 < 40.5 THEN 1 ELSE 2 END::BIGINT AS row, CASE WHEN x < 0.5 OR x >= 100.5 THEN NULL WHEN x < 50.5 THEN 0 WHEN x < 80.5 THEN 1 ELSE 2 END::BIGINT AS col FROM k)
SELECT id, row, col, string_agg('n' || n, ' ' ORDER BY y, x) AS text FROM b JOIN orders ON id = o_orderkey::VARCHAR WHERE row IS NOT NULL AND col IS NOT NULL GROUP BY 1, 2, 3""",
    "through_columns": "SELECT o_orderkey::VARCHAR AS id, 3::BIGINT AS n, 100.5::DOUBLE AS last FROM orders WHERE o_orderkey % 2 = 0",
    "split_lines": """
WITH t AS (SELECT p_partkey, p_size::VARCHAR AS a, p_partkey::VARCHAR AS b FROM part), w AS (SELECT *, 100.0::DOUBLE / (length(a) + 4 + length(b)) AS u FROM t)
SELECT p_partkey, CASE WHEN (u * length(a) / 2 >= 45) = (u * (length(a) + 4 + length(b) / 2) >= 45) THEN (CASE WHEN u * length(a) / 2 >= 45 THEN '1:' ELSE '0:' END) || a || ' ' || b ELSE '0:' || a || '|1:' || b END AS pieces FROM w""",
    "assembled_lines": """
WITH s AS (SELECT l_orderkey AS line, l_linenumber AS n, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2 HAVING l_linenumber <> 3),
g AS (SELECT line, trim(string_agg(' w' || p, '' ORDER BY n)) AS text, array_to_string(list_sort(list_distinct(list(CASE WHEN n % 2 = 0 THEN 'B' ELSE 'A' END))), '/') AS font, coalesce(sum(length(' w' || p)) FILTER (WHERE n < 3), 0) - 1 AS bold, min(q) AS x0, max(q) + 5 AS x1 FROM s GROUP BY 1)
SELECT line, text, font, CASE WHEN bold > 0 THEN '0:' || bold::BIGINT || ':b' ELSE '' END AS emphasis, x0, x1, abs((x0 + x1) / 2 - 30) <= 20 AS centred FROM g""",
    "caption_owners": "WITH o AS (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN 'E' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM events) SELECT event_id, owner FROM o WHERE event_type = 'error'",
    "carried_titles": """
WITH w AS (SELECT user_id, event_id, event_type, event_type || event_id AS t, lead(event_type, 1) OVER p AS k1, lead(event_type || event_id, 1) OVER p AS t1, lead(event_type, 2) OVER p AS k2, lead(event_type || event_id, 2) OVER p AS t2 FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, t || CASE WHEN k1 IN ('view', 'click') THEN ' ' || t1 || CASE WHEN k2 IN ('view', 'click') THEN ' ' || t2 ELSE '' END ELSE '' END AS title FROM w WHERE event_type = 'purchase'""",
    "style_slices": """
WITH h AS (SELECT p_partkey, p_brand, ltrim(substr(p_name, length(p_name) // 2 + 1)) AS t FROM part)
SELECT p_partkey, t || ' ' || p_brand AS text, '0:' || length(t) || ':b,' || (length(t) + 1) || ':' || (length(t) + 1 + length(p_brand)) || ':i' AS emphasis FROM h""",
    "stitched_regions": """
WITH r AS (SELECT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS page, max(o_orderstatus) <> 'P' AS open, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(open) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY page)),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY page) AS t FROM m)
SELECT o_custkey, page, min(page) OVER (PARTITION BY o_custkey, t) AS first_page, (sum(n) OVER (PARTITION BY o_custkey, t ORDER BY page) - n)::BIGINT AS row_start FROM g""",
    "forming_parts": """
WITH a AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS page, l_quantity AS top, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 10 END AS bound FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT l_orderkey, l_quantity, '[f] ' || l_partkey AS text FROM lineitem WHERE l_linenumber % 3 <> 0)
SELECT id, (SELECT first(text ORDER BY l_quantity, text) FROM n WHERE n.l_orderkey = page AND l_quantity > top AND (bound IS NULL OR l_quantity < bound)) AS found FROM a""",
    "pruned_index": """SELECT p_partkey, '{"type":"' || ['ECONOMY', 'PROMO', 'OTHER'][p_size % 3 + 1] || '"' || CASE WHEN p_size % 3 < 2 THEN ',"title":"' || p_name || '"' ELSE '' END || CASE WHEN p_size % 3 = 1 AND p_partkey % 4 <> 0 THEN ',"content":"' || p_brand || '"' ELSE '' END || '}' AS json FROM part""",
    "publish_plan": "SELECT 'N' || n_nationkey AS key, NULL::VARCHAR AS parent, NULL::VARCHAR AS parent_id, 0 AS step FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, CASE WHEN c_nationkey < 10 THEN 'K-N' || c_nationkey END, 1 FROM customer WHERE c_nationkey <> 3",
    "file_report": """
WITH l AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15), r AS (SELECT DISTINCT s_nationkey AS j FROM supplier WHERE s_nationkey > 5)
SELECT CASE WHEN k IS NOT NULL AND j IS NOT NULL THEN k || ': ' || printf('%.1f%%', 100.0 - k) WHEN k IS NOT NULL THEN 'only left: ' || k || '.png' ELSE 'only right: ' || j || '.jpg' END AS line FROM l FULL JOIN r ON k = j""",
    "read_settings": "SELECT p_partkey, p_name AS name, '9' || p_size AS size, 2::BIGINT AS n FROM part",
}
