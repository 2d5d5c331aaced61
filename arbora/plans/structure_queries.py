"""Readers, predicates and record builders of the structure indexers, judging and backlog on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.sources.tables import table

c = F.col


def equation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys owner.node of a user's events, repeats suffixed -n; errors are counted apart."""
    pinned = c("event_type") == "error"
    base = F.concat(c("user_id").cast("string"), F.lit("."), "event_type")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type", pinned).orderBy("event_id"))
    return table(spark, d, "events").select("event_id", F.when(nth == 1, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))).alias("key"))


def page_targets(spark: SparkSession, d: str) -> DataFrame:
    """Pages that have a page of their own: of two hosts' kinds, or below a language prefix."""
    own = c("url").contains("example.org") | (c("url").contains("example.net") & F.rlike("url", F.lit(r"^https?://[^/]+/en/")))
    return table(spark, d, "pages").filter(own).select("page_id")


def usable_sources(spark: SparkSession, d: str) -> DataFrame:
    """One render a key from the cached source, unusable sources skipped."""
    keys = table(spark, d, "orders").select(c("o_custkey").alias("key")).distinct()
    sources = table(spark, d, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("key"), F.coalesce(F.when(c("c_acctbal") > 5000, c("c_name")), F.concat(F.lit("<"), "c_mktsegment", F.lit(">"))).alias("markup"))
    return keys.join(sources, "key")


def markdown_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are table rows, cut into cells, header rules left out."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(c("line").contains(" | "))
    cells = F.transform(F.split("line", r" \| "), lambda x: F.trim(x))
    return lines.filter(~F.rlike("line", F.lit(r"^[-| ]+$"))).select("doc_id", F.size(cells).cast("long").alias("n_cells"), cells[0].alias("first"), F.element_at(cells, -1).alias("last"))


def labelled_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each turn that ends its paragraph's first line, and how many paragraphs there are."""
    parts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("n"), F.regexp_extract(parts[0], r"^([^.]*)\.", 1).alias("first"))


def caption_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Captions among part names in fonts by brand: bold ones, or plain ones that are bare."""
    made = F.concat(F.when(c("p_size") % 2 == 0, "Table ").otherwise("Figure "), c("p_size").cast("string"), F.when(c("p_partkey") % 3 == 0, "").otherwise(" more"))
    bold = c("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
    bare = F.rlike(made, F.lit(r"^(Table|Figure)\s+([A-Z]-)?\d+(\.\d+)*\.?(-[A-Z])?$"))
    return table(spark, d, "part").filter(bold | bare).select("p_partkey", F.regexp_extract(made, r"^(Table|Figure)\s+(\S.*)$", 1).alias("kind"))


def font_families(spark: SparkSession, d: str) -> DataFrame:
    """Families of font names made from part types."""
    font = F.concat(F.initcap("p_type"), F.when(c("p_size") % 2 == 0, "-BoldMT").otherwise("PS-Italic"))
    return table(spark, d, "part").groupBy(F.regexp_extract(font, r"^([A-Za-z]*?)(?=MT|PS|-|/|$)", 1).alias("family")).agg(F.count("*").alias("n"))


def numbering_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images in three groups: equations by shape or tag, figures, and those that carry no key; numbered within theirs."""
    w, h = c("l_quantity") * 5, c("l_linenumber") * 12
    group = F.when((c("l_returnflag") == "N") | ((w > h) & (h <= 70) & (w / h >= 2)), "Eq").when(w * h < 1600, "none").otherwise("Fig")
    rows = table(spark, d, "lineitem").select("l_orderkey", group.alias("kind"))
    return rows.groupBy("l_orderkey", "kind").agg(F.when(c("kind") != "none", F.count("*")).alias("n_keys"))


def drop_vectors_over_tables(spark: SparkSession, d: str) -> DataFrame:
    """Vector crops that overlap a table box of their page go, rasters never do."""
    x = c("l_quantity")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", x.alias("x0"), (x + 4).alias("x1"))
    tables = rows.filter("l_returnflag = 'R'").select(c("l_orderkey").alias("page"), c("x0").alias("t0"), c("x1").alias("t1"))
    over = (c("l_orderkey") == c("page")) & (c("x0") < c("t1")) & (c("t0") < c("x1")) & (c("l_linestatus") == "F")
    return rows.filter("l_returnflag <> 'R'").join(tables, over, "left_anti").select("l_orderkey", "l_partkey")


def rule_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles as horizontal or vertical rules by thickness, in bands of the page."""
    kind = F.when(c("l_tax") * 100 <= 2, "horizontal").when(c("l_quantity") <= 2, "vertical").otherwise("box")
    inside = (c("l_extendedprice") > 1000 - 2) & (c("l_extendedprice") <= 50000)
    return table(spark, d, "lineitem").filter(inside).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def row_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of an order whose ends both lie on a column edge, edges being the quantities of returned lines."""
    rows = table(spark, d, "lineitem")
    edges = rows.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_quantity").alias("edges"))
    near = lambda x: F.exists("edges", lambda e: F.abs(e - x) <= 2)
    return rows.filter("l_returnflag <> 'R'").join(edges, "l_orderkey").filter(near(c("l_quantity")) & near(c("l_quantity") + 10)).select("l_orderkey", "l_partkey")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of orders by type."""
    kind = F.element_at(F.array(*map(F.lit, ("Part", "Section", "Article", "Note"))), (c("o_orderkey") % 4 + 1).cast("int"))
    shown = F.when(kind == "Note", F.concat(F.lit("Note-A-"), c("o_orderkey").cast("string"))).when(kind == "Part", F.concat(F.lit("Part "), c("o_custkey").cast("string"))).otherwise(F.concat_ws(".", kind, c("o_custkey").cast("string"), c("o_orderkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("citation"))


def primary_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of customers without their empty parts, and the first of the photos that is primary and no default."""
    address = F.concat_ws(", ", F.when(c("c_acctbal") > 0, c("c_mktsegment")), F.concat(F.lit("N"), c("c_nationkey").cast("string")))
    photos = F.array(*(F.struct(F.concat(c("c_name"), F.lit(f"/{i}")).alias("url"), (c("c_custkey") % 3 == i).alias("primary"), (c("c_custkey") % 5 == i).alias("default")) for i in range(3)))
    chosen = F.filter(photos, lambda p: p["primary"] & ~p["default"])
    return table(spark, d, "customer").select("c_custkey", address.alias("address"), F.get(chosen, 0)["url"].alias("photo"))


def box_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose four edges are numbers and in order; others are no location."""
    edges = [F.expr(f"try_cast(json_extract.{k} AS double)") for k in ("k",)]
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("json_extract"))
    number = F.when(c("event_id") % 4 == 0, F.lit(None)).otherwise(edges[0])
    return rows.select("event_id", F.when(number.isNotNull() & (number > 10), F.concat_ws(",", F.lit("10"), number.cast("int").cast("string"))).alias("box"))


def error_routes(spark: SparkSession, d: str) -> DataFrame:
    """Errors as rate limits, transient or permanent, by a status in their properties."""
    status = F.get_json_object("props", "$.k").cast("int") + 400
    route = F.when(status == 429, "rate limit").when((status >= 490) | (status == 408), "transient").otherwise("permanent")
    return table(spark, d, "events").filter("event_type = 'error'").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def images_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the images that it owns, in order."""
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",")
    return rows.groupBy("l_orderkey").agg(listed.alias("images"))


def note_reparenting(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers move under the customer of the same number in the same nation; those without one stay where they are."""
    parts = table(spark, d, "customer").select(c("c_nationkey").alias("s_nationkey"), (c("c_custkey") % 10).alias("number"), c("c_custkey").alias("part")).groupBy("s_nationkey", "number").agg(F.min("part").alias("part"))
    left = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (c("s_suppkey") % 10).alias("number"))
    return left.join(parts, ["s_nationkey", "number"], "left").select("s_suppkey", F.when(c("part").isNotNull(), F.concat(F.lit("part "), c("part").cast("string"))).otherwise("unmoved").alias("parent"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Every page's distinct links, each with the first page that has it and the number of pages that do, read once a link."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("word"))
    known = links.groupBy("word").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))
    return links.join(known, "word").select("page_id", "word", "n_pages", "first_page")


def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of tokens by the millions, unknown without a price."""
    price = F.when(c("p_type") != "ECONOMY", F.lit(2.5))
    return table(spark, d, "part").groupBy("p_type").agg(F.sum("p_size").alias("tokens")).select("p_type", "tokens", F.round(c("tokens") * price / 1e6, 9).alias("cost"))


def unnamed_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures without an id are numbered within their holder."""
    named = F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("id"), c("l_partkey").cast("string")))
    nth = F.row_number().over(Window.partitionBy("l_orderkey", named.isNull()).orderBy("l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.coalesce(named, F.concat(c("l_orderkey").cast("string"), F.lit(".figure"), nth.cast("string"))).alias("figure_id"))


def pair_classes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each pair, in order: one side only, skipped, unreadable, settled by hash, to judge."""
    state = F.when(c("l_returnflag") == "N", "web only").when(c("l_tax") == 0, "skipped").when(c("l_quantity") < 3, "unreadable").when(c("l_discount") >= 0.09, "hash match").otherwise("judge")
    return table(spark, d, "lineitem").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def interrupted_run(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without a verdict when a run ends become errors, in the order of the pairs."""
    pairs = table(spark, d, "orders").select("o_orderkey")
    verdicts = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("verdict"))
    return pairs.join(verdicts, "o_orderkey", "left").select("o_orderkey", F.coalesce("verdict", F.lit("error")).alias("verdict"))


def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of failed leaves alone: no counterpart, a difference, or an image inside."""
    reason = F.when(c("o_orderkey") % 11 == 0, "no counterpart").when(c("o_orderkey") % 7 == 0, "differs").when(c("images") > 0, "image inside")
    images = table(spark, d, "lineitem").filter("l_tax > 0.07 AND l_returnflag = 'R'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("images"))
    return table(spark, d, "orders").select("o_orderkey").join(images, "o_orderkey", "left").withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def style_runs(spark: SparkSession, d: str) -> DataFrame:
    """Touching ranges of one style merged into one: lines of an order as ranges of ten, styled by their flag."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("style"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    touches = (F.lag("style").over(order) == c("style")) & (F.lag("l_linenumber").over(order) == c("l_linenumber") - 1)
    runs = rows.withColumn("new", F.when(touches, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("l_orderkey", "run", "style").agg((F.min("l_linenumber") * 10).alias("start"), (F.max("l_linenumber") * 10 + 10).alias("end"))


QUERIES = {f.__name__: f for f in (equation_keys, page_targets, usable_sources, markdown_records, labelled_paragraphs, caption_predicate, font_families, numbering_groups, drop_vectors_over_tables, rule_kinds, row_rules, citations, primary_addresses, box_sanity, error_routes, images_by_owner, note_reparenting, page_links, call_costs, unnamed_figures, pair_classes, interrupted_run, failure_reasons, style_runs)}

ORACLES = {
    "equation_keys": "WITH n AS (SELECT event_id, user_id || '.' || event_type AS base, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) SELECT event_id, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS key FROM n",
    "page_targets": "SELECT page_id FROM pages WHERE contains(url, 'example.org') OR (contains(url, 'example.net') AND regexp_matches(url, '^https?://[^/]+/en/'))",
    "usable_sources": "SELECT c_custkey AS key, CASE WHEN c_acctbal > 5000 THEN c_name ELSE '<' || c_mktsegment || '>' END AS markup FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "markdown_records": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, string_split(line, ' | ') AS xs FROM l WHERE contains(line, ' | ') AND NOT regexp_full_match(line, '[-| ]+'))
SELECT doc_id, len(xs)::BIGINT AS n_cells, trim(xs[1], ' ') AS first, trim(xs[-1], ' ') AS last FROM p""",
    "labelled_paragraphs": "WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS xs FROM conversations) SELECT conv_id, turn, len(xs)::BIGINT AS n, regexp_extract(xs[1], '^([^.]*)\\.', 1) AS first FROM p",
    "caption_predicate": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Table' ELSE 'Figure' END AS kind FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_partkey % 3 = 0",
    "font_families": "SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS family, count(*) AS n FROM part GROUP BY 1",
    "numbering_groups": """
WITH g AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' OR (l_quantity * 5 > l_linenumber * 12 AND l_linenumber * 12 <= 70 AND l_quantity * 5 / (l_linenumber * 12) >= 2) THEN 'Eq' WHEN l_quantity * 5 * l_linenumber * 12 < 1600 THEN 'none' ELSE 'Fig' END AS kind FROM lineitem)
SELECT l_orderkey, kind, CASE WHEN kind <> 'none' THEN count(*) END AS n_keys FROM g GROUP BY 1, 2""",
    "drop_vectors_over_tables": "SELECT l_orderkey, l_partkey FROM lineitem a WHERE l_returnflag <> 'R' AND NOT (l_linestatus = 'F' AND EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R' AND t.l_orderkey = a.l_orderkey AND a.l_quantity < t.l_quantity + 4 AND t.l_quantity < a.l_quantity + 4))",
    "rule_kinds": "SELECT CASE WHEN l_tax * 100 <= 2 THEN 'horizontal' WHEN l_quantity <= 2 THEN 'vertical' ELSE 'box' END AS kind, count(*) AS n FROM lineitem WHERE l_extendedprice > 998 AND l_extendedprice <= 50000 GROUP BY 1",
    "row_rules": "SELECT l_orderkey, l_partkey FROM lineitem a WHERE l_returnflag <> 'R' AND EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = a.l_orderkey AND e.l_returnflag = 'R' AND abs(e.l_quantity - a.l_quantity) <= 2) AND EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = a.l_orderkey AND e.l_returnflag = 'R' AND abs(e.l_quantity - a.l_quantity - 10) <= 2)",
    "citations": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Part ' || o_custkey WHEN 1 THEN 'Section.' || o_custkey || '.' || o_orderkey WHEN 2 THEN 'Article.' || o_custkey || '.' || o_orderkey ELSE 'Note-A-' || o_orderkey END AS citation FROM orders",
    "primary_addresses": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment || ', ' ELSE '' END || 'N' || c_nationkey AS address, CASE WHEN c_custkey % 3 <> c_custkey % 5 THEN c_name || '/' || c_custkey % 3 END AS photo FROM customer",
    "box_sanity": "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND json_extract_string(props, '$.k')::INT > 10 THEN '10,' || json_extract_string(props, '$.k') END AS box FROM events",
    "error_routes": "WITH s AS (SELECT json_extract_string(props, '$.k')::INT + 400 AS status FROM events WHERE event_type = 'error') SELECT CASE WHEN status = 429 THEN 'rate limit' WHEN status >= 490 OR status = 408 THEN 'transient' ELSE 'permanent' END AS route, count(*) AS n FROM s GROUP BY 1",
    "images_by_owner": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS images FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "note_reparenting": "SELECT s_suppkey, coalesce('part ' || (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10), 'unmoved') AS parent FROM supplier",
    "page_links": "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS word FROM pages) SELECT page_id, word, count(*) OVER (PARTITION BY word) AS n_pages, min(page_id) OVER (PARTITION BY word) AS first_page FROM l",
    "call_costs": "SELECT p_type, sum(p_size)::BIGINT AS tokens, CASE WHEN p_type <> 'ECONOMY' THEN round(sum(p_size) * 2.5 / 1e6, 9) END AS cost FROM part GROUP BY 1",
    "unnamed_figures": "SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'id' || l_partkey ELSE l_orderkey || '.figure' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 0 ORDER BY l_linenumber, l_partkey) END AS figure_id FROM lineitem",
    "pair_classes": "SELECT CASE WHEN l_returnflag = 'N' THEN 'web only' WHEN l_tax = 0 THEN 'skipped' WHEN l_quantity < 3 THEN 'unreadable' WHEN l_discount >= 0.09 THEN 'hash match' ELSE 'judge' END AS state, count(*) AS n FROM lineitem GROUP BY 1",
    "interrupted_run": "SELECT o_orderkey, coalesce((SELECT min(l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A'), 'error') AS verdict FROM orders",
    "failure_reasons": """
WITH i AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax > 0.07 AND l_returnflag = 'R'), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'no counterpart' WHEN o_orderkey % 7 = 0 THEN 'differs' WHEN o_orderkey IN (SELECT l_orderkey FROM i) THEN 'image inside' END AS reason FROM orders)
SELECT reason, count(*) AS n, min(o_orderkey) AS first FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "style_runs": """
WITH s AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS style FROM lineitem GROUP BY 1, 2), n AS (SELECT *, CASE WHEN lag(style) OVER w = style AND lag(l_linenumber) OVER w = l_linenumber - 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM n) SELECT l_orderkey, run, style, min(l_linenumber) * 10 AS start, max(l_linenumber) * 10 + 10 AS "end" FROM r GROUP BY 1, 2, 3""",
}
