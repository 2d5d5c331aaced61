"""Tree comparison, placing and site content on the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import site
from arbora.functions.text import plain_characters
from arbora.operators import compare, islands
from arbora.sources.staging import staged
from arbora.sources.tables import table

c = F.col


def _string(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _grids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as tables within their customer, and their lines as rows of three cells."""
    tables = table(spark, d, "orders").select(_string(c("o_custkey")).alias("scope"), c("o_orderkey").alias("ord"), _string("T", c("o_orderkey")).alias("key"), _string("Order ", c("o_orderkey"), " Forming Part of Sentence 1").alias("title"), "o_orderkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_quantity").cast("int").alias("q"))
    row = _string("T", c("l_orderkey"), ".", c("l_linenumber"), ".", c("l_partkey"), ".", c("l_suppkey"))
    contents = F.array(_string(c("l_partkey"), "/", c("l_suppkey"), "/", c("l_linenumber")), F.lit(""), _string("q", c("q")))
    cells = lines.select(_string("T", c("l_orderkey")).alias("table"), (c("l_linenumber").cast("long") * 10**13 + c("l_partkey") * 10**6 + c("l_suppkey")).alias("row_ord"), row.alias("row_key"), F.posexplode(contents).alias("cell_ord", "content"), "l_orderkey", "l_linenumber")
    return tables, cells.withColumn("cell_key", _string(c("row_key"), "-", c("cell_ord")))


def scoped_counterparts(spark: SparkSession, d: str) -> DataFrame:
    """Tables, rows and cells against a side that lacks third lines and has each seventh order under another head, so that it pairs with none."""
    tables, cells = _grids(spark, d)
    moved = c("o_orderkey") % 7 == 0
    others = tables.withColumn("scope", F.when(moved, "moved").otherwise(c("scope"))).withColumn("title", F.when(moved, "Moved").otherwise(_string("Order ", c("o_orderkey"), "^{(1)}")))
    kept = cells.filter("l_linenumber <> 3")
    return compare.counterparts(tables, others, cells, kept)


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, orders and lines as one tree, the other side's nodes, and images of orders."""
    customers = table(spark, d, "customer").select(_string("C", c("c_custkey")).alias("path"), F.lit("Part").alias("type"), F.lit("").alias("content"), F.lit(-1).cast("long").alias("order"), F.lit(0).alias("line"))
    orders = table(spark, d, "orders")
    up = _string("C", c("o_custkey"), "/O", c("o_orderkey"))
    rows = orders.select(up.alias("path"), F.lit("Row").alias("type"), F.lit("").alias("content"), c("o_orderkey").alias("order"), F.lit(0).alias("line"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").alias("q"))
    cells = lines.join(orders, c("l_orderkey") == c("o_orderkey")).select(F.concat(up, F.lit("/L"), c("l_linenumber").cast("string")).alias("path"), F.lit("Cell").alias("type"), F.when(c("q") < 5, " ").otherwise(_string("part ", c("part"), "–", c("q").cast("int"))).alias("content"), c("l_orderkey").alias("order"), c("l_linenumber").alias("line"))
    nodes = customers.unionByName(rows).unionByName(cells).withColumn("key", F.replace("path", F.lit("/"), F.lit(".")))
    changed = F.when((c("line") == 2) & (c("order") % 5 == 0), _string(c("content"), "!")).otherwise(F.replace("content", F.lit("–"), F.lit("-")))
    others = nodes.filter("line <> 3 AND NOT (line = 0 AND order >= 0 AND order % 11 = 0)").select("key", changed.alias("content"))
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((c("l_tax") > 0.07) & (c("l_returnflag") == "R")).alias("bad"))
    images = orders.join(flags, c("l_orderkey") == c("o_orderkey")).select(up.alias("owner_path"), _string("Fig", c("o_orderkey")).alias("key"), (~c("bad")).alias("ok"))
    return nodes, others, images


def _statuses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, others, images = _trees(spark, d)
    settled = spark.createDataFrame([], "left_key string, right_key string")
    return compare.compared(nodes.select("path", "key", "type", "content"), others, settled, images, lambda a, b: plain_characters(a) == plain_characters(b)), images


def compared_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every node's own and rolled-up status: text, images, containers and empty cells under rows that have a counterpart."""
    return _statuses(spark, d)[0].select("key", "own_ok", "ok")


def told_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of failed leaves and images."""
    statuses, images = _statuses(spark, d)
    failed = staged(statuses.filter("NOT ok"))  # what fails by itself is not ok
    differs = failed.filter("met AND NOT own_ok").select("key", F.lit("text").alias("kind"))
    settled = spark.createDataFrame([], "left_key string, right_key string")
    there = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(_string("Fig", c("o_orderkey")).alias("key"))
    return compare.leaf_reasons(failed, differs).unionByName(compare.image_reasons(images.select("key", "ok"), there, settled))


def placed_by_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Parts placed by their own id, else by brand, else by the first word of their type."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    spot = lambda key, x: table(spark, d, "part").groupBy(key.alias("id")).agg(F.min(x).alias("spot"))
    by_id = table(spark, d, "part").filter("p_size > 45").select(_string(c("p_partkey")).alias("id"), c("p_size").alias("spot"))
    by_brand = spot(F.when(c("p_brand") < "Brand#3", c("p_brand")), "p_retailprice").filter("id IS NOT NULL").withColumn("spot", c("spot").cast("int"))
    by_type = spot(F.substring("p_type", 1, 1), "p_size")
    sources = [(by_id, _string(c("p_partkey"))), (by_brand, c("p_brand")), (by_type, F.substring("p_type", 1, 1))]
    return compare.by_precedence(part, "id", sources, ["spot"]).select("p_partkey", "spot")


def placed_in_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of orders' tables on their rendered grids, which leave out covered cells of the head."""
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("table"))
    grid = lambda cells: orders.select("table", F.posexplode(cells).alias("row_ord", "cells")).select("table", "row_ord", F.posexplode("cells").alias("cell_ord", "content"))
    row = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    ours = grid(F.array(row("a", "", "b"), row(_string(c("table")), "", "x"), row("lost", "kept", "too"))).withColumn("cell", _string(c("row_ord"), ".", c("cell_ord")))
    theirs = grid(F.array(row("a", "b"), row(_string(c("table")), "", "x"), row("lost", "kept"))).withColumn("place", _string("at", c("cell_ord"))).withColumnRenamed("content", "text")
    placed = staged(compare.placed_cells(ours, theirs))  # read again for what was lost
    lost = compare.misaligned_rows(ours, placed).withColumn("cell", F.lit(None).cast("string")).withColumn("place", F.lit("misaligned"))
    return placed.unionByName(lost).select("table", "cell", "place")


def attached_notes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under the first customer of their nation and number; what no customer cites is left out."""
    owners = table(spark, d, "customer").select(_string(c("c_nationkey"), "-", c("c_custkey") % 10).alias("citation"), c("c_custkey").alias("node_id"))
    rows = table(spark, d, "supplier").select("s_suppkey", _string(c("s_nationkey"), "-", c("s_suppkey") % 10).alias("owner"))
    return compare.attached(rows, owners).select("s_suppkey", "parent_id")


def shown_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The nearest node at or above each customer, order and region that a viewer shows."""
    nation = table(spark, d, "nation")
    nodes = nation.select(_string(c("n_regionkey")).alias("path")).distinct().unionByName(nation.select(_string(c("n_regionkey"), "/", c("n_nationkey")).alias("path")))
    customers = table(spark, d, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).select(_string(c("n_regionkey"), "/", c("n_nationkey"), "/", c("c_custkey")).alias("path"))
    shown = (F.size(F.split("path", "/")) < 3) & (F.element_at(F.split("path", "/"), -1).cast("int") % 2 == 0)
    return compare.nearest_shown(nodes.unionByName(customers), shown, 3).select("path", "host")


def _json(spark: SparkSession, d: str) -> DataFrame:
    """Each order as site content: a table of its lines, a sentence of clauses, a note, and a formula."""
    cell = lambda *value: F.struct(F.array(F.struct(F.lit("text").alias("type"), _string(*value).alias("value"))).alias("content"), F.lit(1).alias("rowspan"))
    row = lambda x: F.struct(F.array(cell(x["l_partkey"]), cell("s", x["l_suppkey"])).alias("cells"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("xs"))
    own = _string(c("l_orderkey"))
    head = F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("head").alias("value"))).alias("content"), F.lit(2).alias("colspan"))).alias("cells")))
    tables = F.struct(F.lit("table").alias("type"), _string("T.", own).alias("id"), F.lit("Lines").alias("title"), F.struct(head.alias("header_rows"), F.transform("xs", row).alias("body_rows")).alias("structure"))
    clauses = F.transform("xs", lambda x, i: F.struct(F.when(x["l_linenumber"] < 5, F.concat(F.lit("c"), i.cast("string"))).alias("id"), x["l_partkey"].cast("string").alias("text"), F.array(F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), x["l_linenumber"].alias("number"), F.lit("sub").alias("text"))).alias("subclauses")))
    sentence = F.struct(F.lit("sentence").alias("type"), _string("S.", own).alias("id"), F.lit(3).alias("number"), F.lit("Shall be:").alias("text"), clauses.alias("clauses"))
    note = F.concat(F.lit('{"type": "note", "id": "N.'), own, F.lit('", "number": "'), own, F.lit('", "title": "On it", "content": [{"content": "first"}, '), F.to_json(tables), F.lit(', {"content": "last "}]}'))
    formula = F.struct(_string("E.", own).alias("id"), F.when(c("l_orderkey") % 2 == 0, _string("x^", own)).alias("latex"), F.when(c("l_orderkey") % 2 == 1, F.lit("x")).alias("plainText"))
    return rows.select("l_orderkey", F.concat(F.lit('{"type": "article", "content": ['), F.to_json(sentence), F.lit('], "more": {"note": '), note, F.lit(', "formula": '), F.to_json(formula), F.lit("}}")).alias("json"))


def site_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables, rows and cells of site content, a head spanning both columns."""
    return islands.extracted(_json(spark, d), "l_orderkey", "json", partial(site.table_nodes, laid_out=islands.laid_out)).select("type", "citation", "parent", "identifier", "content")


def site_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, clauses with an id lettered by place, subclauses in roman numerals."""
    return islands.extracted(_json(spark, d), "l_orderkey", "json", site.sentence_nodes).select("l_orderkey", "type", "citation", "parent", "identifier", "content")


def site_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their texts, tables left out, and formulas."""
    return islands.extracted(_json(spark, d), "l_orderkey", "json", site.note_nodes, site.formula_nodes).select("type", "citation", "identifier", "title", "content")


def navigation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations as the nodes of navigation trees."""
    nation = F.struct(c("n_nationkey"), F.struct(F.lit("part").alias("type"), _string("n", c("n_nationkey")).alias("id"), c("n_nationkey").alias("number"), c("n_name").alias("title")).alias("node"))
    trees = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(nation)).alias("xs"))
    tree = F.struct(F.lit("division").alias("type"), _string("r", c("n_regionkey")).alias("id"), F.lit("Division B").alias("title"), F.transform("xs", lambda x: x["node"]).alias("children"))
    return islands.extracted(trees.select("n_regionkey", F.to_json(tree).alias("json")), "n_regionkey", "json", site.navigation_nodes).select("type", "citation", "parent", "identifier", "title")


def dated_content(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of a user's events as revised items of nested content, as of a day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    revision = F.struct(F.lit("amendment").alias("type"), day.alias("effective_date"), c("event_id").alias("sequence"), (c("value") < 20).alias("deleted"), F.floor("value").alias("value"))
    items = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(revision).alias("revisions"))
    item = F.struct(c("event_type").alias("id"), F.lit(True).alias("revised"), F.lit(-1).alias("value"), "revisions")
    content = items.groupBy("user_id").agg(F.collect_list(item).alias("items")).select("user_id", F.to_json(F.struct(F.struct("items").alias("body"))).alias("json"))
    found = content.select("user_id", F.from_json(islands.dated(c("json"), "2024-01-10"), "body struct<items: array<struct<id: string, value: bigint>>>").alias("x"))
    return found.select("user_id", F.explode("x.body.items").alias("i")).select("user_id", "i.id", "i.value")


QUERIES = {f.__name__: f for f in (scoped_counterparts, compared_tree, told_reasons, placed_by_precedence, placed_in_grid, attached_notes, shown_hosts, site_tables, site_sentences, site_notes, navigation_rows, dated_content)}

_TREE = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
leaf AS (SELECT 'C' || o_custkey AS c, 'C' || o_custkey || '.O' || o_orderkey AS o, 'C' || o_custkey || '.O' || o_orderkey || '.L' || l_linenumber AS key, l_linenumber <> 3 AS met, CASE WHEN l_linenumber = 3 THEN o_orderkey % 11 <> 0 AND q < 5 ELSE NOT (l_linenumber = 2 AND o_orderkey % 5 = 0) END AS own_ok FROM l JOIN orders ON l_orderkey = o_orderkey),
img AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax > 0.07 AND l_returnflag = 'R'),
ord AS (SELECT 'C' || o_custkey AS c, 'C' || o_custkey || '.O' || o_orderkey AS key, o_orderkey, o_orderkey % 11 <> 0 AS own_ok, o_orderkey % 11 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM img) AND NOT EXISTS (SELECT 1 FROM leaf WHERE leaf.o = 'C' || o_custkey || '.O' || o_orderkey AND NOT leaf.own_ok) AS ok FROM orders)"""
_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem"
ORACLES = {
    "scoped_counterparts": """
WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, 'T' || l_orderkey AS t, 'T' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS row FROM lineitem)
SELECT 'T' || o_orderkey AS left_key, CASE WHEN o_orderkey % 7 <> 0 THEN 'T' || o_orderkey END AS right_key FROM orders
UNION ALL SELECT row, CASE WHEN o % 7 <> 0 AND n <> 3 THEN row END FROM r
UNION ALL SELECT row || '-' || k, CASE WHEN o % 7 <> 0 AND n <> 3 THEN row || '-' || k END FROM r, (SELECT unnest([0, 1, 2]) AS k)""",
    "compared_tree": _TREE + """
SELECT key, own_ok, own_ok AS ok FROM leaf UNION ALL SELECT key, own_ok, ok FROM ord
UNION ALL SELECT 'C' || c_custkey, true, NOT EXISTS (SELECT 1 FROM ord WHERE ord.c = 'C' || c_custkey AND NOT ord.ok) FROM customer""",
    "told_reasons": _TREE + """
SELECT key, CASE WHEN met THEN 'text' ELSE 'no_web' END AS kind FROM leaf WHERE NOT own_ok
UNION ALL SELECT key, 'no_web' FROM ord WHERE NOT ok AND key NOT IN (SELECT o FROM leaf) AND NOT own_ok
UNION ALL SELECT 'Fig' || o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'image_differs' ELSE 'no_web_image' END FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM img)""",
    "placed_by_precedence": """
WITH b AS (SELECT p_brand, min(p_retailprice) AS spot FROM part WHERE p_brand < 'Brand#3' GROUP BY 1), t AS (SELECT left(p_type, 1) AS k, min(p_size) AS spot FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 45 THEN p_size WHEN b.p_brand IS NOT NULL THEN floor(b.spot)::INT ELSE t.spot END AS spot FROM part LEFT JOIN b ON part.p_brand = b.p_brand LEFT JOIN t ON left(p_type, 1) = t.k""",
    "placed_in_grid": "SELECT o_orderkey AS \"table\", cell, place FROM orders, (VALUES ('0.0', 'at0'), ('0.2', 'at1'), ('1.0', 'at0'), ('1.1', 'at1'), ('1.2', 'at2'), (NULL, 'misaligned')) v(cell, place)",
    "attached_notes": "SELECT s_suppkey, min(c_custkey) AS parent_id FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10 GROUP BY 1",
    "shown_hosts": """
WITH n AS (SELECT n_regionkey AS r, n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey || '/' || n_nationkey WHEN n_regionkey % 2 = 0 THEN n_regionkey::VARCHAR END AS host FROM nation)
SELECT DISTINCT r::VARCHAR AS path, CASE WHEN r % 2 = 0 THEN r::VARCHAR END AS host FROM n UNION ALL SELECT r || '/' || n, host FROM n UNION ALL SELECT r || '/' || n || '/' || c_custkey, host FROM customer JOIN n ON c_nationkey = n""",
    "site_tables": f"""
WITH l AS ({_LINES}), h AS (SELECT DISTINCT 'T.' || l_orderkey AS t, l_orderkey AS o FROM l)
SELECT 'Table' AS type, t AS citation, '' AS parent, o::VARCHAR AS identifier, '' AS content FROM h UNION ALL SELECT 'Row', t || '-row1', t, 'row1', '' FROM h
UNION ALL SELECT 'Cell', t || '-row1-col' || k, t || '-row1', 'col' || k, CASE k WHEN 1 THEN 'head' ELSE '' END FROM h, (SELECT unnest([1, 2]) AS k)
UNION ALL SELECT 'Row', 'T.' || l_orderkey || '-row' || (i + 1), 'T.' || l_orderkey, 'row' || (i + 1), '' FROM l
UNION ALL SELECT 'Cell', 'T.' || l_orderkey || '-row' || (i + 1) || '-col' || k, 'T.' || l_orderkey || '-row' || (i + 1), 'col' || k, CASE k WHEN 1 THEN l_partkey::VARCHAR ELSE 's' || l_suppkey END FROM l, (SELECT unnest([1, 2]) AS k)""",
    "site_sentences": f"""
WITH l AS ({_LINES}), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS n FROM l WHERE l_linenumber < 5)
SELECT DISTINCT l_orderkey, 'Sentence' AS type, 'S.' || l_orderkey AS citation, '' AS parent, '(3)' AS identifier, 'Shall be:' AS content FROM l
UNION ALL SELECT l_orderkey, 'Clause', 'c' || (i - 1), 'S.' || l_orderkey, '(' || chr(96 + n::INT) || ')', l_partkey::VARCHAR FROM k
UNION ALL SELECT l_orderkey, 'Subclause', 's' || (i - 1), 'c' || (i - 1), '(' || ['i', 'ii', 'iii', 'iv'][l_linenumber] || ')', 'sub' FROM k""",
    "site_notes": "WITH o AS (SELECT DISTINCT l_orderkey AS o FROM lineitem) SELECT 'Note' AS type, 'N.' || o AS citation, 'A-' || o AS identifier, 'On it' AS title, 'first last' AS content FROM o UNION ALL SELECT 'Equation', 'E.' || o, '', '', CASE WHEN o % 2 = 0 THEN 'x^' || o ELSE 'x' END FROM o",
    "navigation_rows": "SELECT DISTINCT 'division' AS type, 'r' || n_regionkey AS citation, '' AS parent, 'B' AS identifier, 'Division B' AS title FROM nation UNION ALL SELECT 'part', 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey = 0 THEN '' ELSE n_nationkey::VARCHAR END, n_name FROM nation",
    "dated_content": """
WITH v AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') <= '2024-01-10')
SELECT user_id, event_type AS id, floor(value)::BIGINT AS value FROM v WHERE n = 1 AND value >= 20""",
}
