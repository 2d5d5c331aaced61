"""Owners by place, end pages over levels, records of tables, choices among variants and decisions on images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.records import shows_formula_error
from arbora.functions.text import slug
from arbora.operators.joins import as_of_or_first, deepest_owner, required
from arbora.operators.pages import selected
from arbora.operators.windows import end_pages_down, table_records
from arbora.sources.tables import table

c = F.col


def _string(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def division_or_first(spark: SparkSession, d: str) -> DataFrame:
    """Errors under the latest view of their user at or before them, under the first one where they come before all."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.filter("event_type = 'view'").select("user_id", "ts", c("event_id").alias("view_id"))
    return as_of_or_first(events.filter("event_type = 'error'"), views, ["user_id"], "ts", "view_id", "view_id").select("event_id", "view_id")


def deepest_owners(spark: SparkSession, d: str) -> DataFrame:
    """Errors under the latest click since their user's latest purchase, else under the purchase itself."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kind = lambda k: events.filter(c("event_type") == k)
    tops = kind("purchase").select("user_id", "ts", _string("p", c("event_id")).alias("node"), F.lit(None).cast("string").alias("parent"))
    under = deepest_owner(kind("click"), [tops], ["user_id"], "ts", "parent").filter("parent IS NOT NULL").select("user_id", "ts", _string("c", c("event_id")).alias("node"), "parent")
    return deepest_owner(kind("error"), [tops, under], ["user_id"], "ts").select("event_id", "owner")


def required_specs(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation's record; one without a nation would be an error."""
    nation = table(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return required(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "nation").select("c_custkey", "n_name")


def leveled_end_pages(spark: SparkSession, d: str) -> DataFrame:
    """Nations, their customers and those's orders in days: each ends before its next sibling, the last with its parent."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey")).select(_string("O", c("o_orderkey")).alias("node"), _string("C", c("c_custkey")).alias("parent"), day.alias("page"), c("c_nationkey"))
    customers = orders.groupBy(c("parent").alias("node"), _string("N", c("c_nationkey")).alias("parent")).agg(F.min("page").alias("page"))
    nations = customers.groupBy(c("parent").alias("node")).agg(F.min("page").alias("page")).withColumn("parent", F.lit(""))
    levels = end_pages_down([nations, customers, orders.drop("c_nationkey")], F.lit(20000))
    return levels[0].unionByName(levels[1]).unionByName(levels[2]).select("node", c("end_page").cast("int").alias("end_page"))


def positioned_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an order's lines by place (page, then height), ties in the order of the walk."""
    place = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.concat(c("l_orderkey").cast("string"), F.lit(".Fig"), F.row_number().over(place).cast("string")).alias("key"))


def markdown_epics(spark: SparkSession, d: str) -> DataFrame:
    """Rows of backlog tables read back from Markdown made of parts."""
    row = F.struct(c("p_partkey"), _string("| ", c("p_partkey"), " | ", c("p_name"), " | a; b | ", c("p_type"), " |").alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["line"]), "\n")
    texts = table(spark, d, "part").groupBy("p_brand").agg(body.alias("rows"))
    text = F.concat(F.lit("# Plan\n## Epic "), slug(c("p_brand")), F.lit("\nA note | with a bar\n\n| # | Story | Criteria | Status |\n|---|---|---|---|\n"), c("rows"), F.lit("\n## Other\n| 9 | not | one | of them |\n| 9 | not | one | of them |"))
    found = table_records(texts.select("p_brand", text.alias("text")), "p_brand", "text", r"^## Epic (\S+)", ["number", "story", "criteria", "status"])
    criteria = F.filter(F.split("criteria", "; "), lambda x: F.trim(x) != "")
    return found.select(c("heading").alias("epic"), c("number").cast("long").alias("number"), "story", F.size(criteria).cast("long").alias("n_criteria"), slug(c("status")).alias("label"))


def kept_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Of the variants that keep every verdict of the first where both judge a part, the one of least tokens; null if none does."""
    lines = table(spark, d, "lineitem").groupBy("l_linenumber", "l_partkey").agg(F.min("l_returnflag").alias("verdict"), F.sum("l_quantity").cast("long").alias("tokens"))
    base = lines.filter("l_linenumber = 1").select("l_partkey", c("verdict").alias("base"))
    joined = lines.join(base, "l_partkey", "left").groupBy("l_linenumber").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.bool_and(c("verdict") == c("base")), F.lit(False)).alias("keeps"), F.count("base").alias("both"))
    return joined.agg(F.min_by("l_linenumber", F.when(c("keeps"), F.struct("tokens", "l_linenumber"))).alias("best"), F.count_if("keeps").alias("n_keeping"), F.sum("both").alias("judged_twice"))


def variant_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line of text on each variant against the one of the same kind that stands alone."""
    variants = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("tokens"))
    alone = variants.filter("l_linestatus = 'F'").select("l_returnflag", c("tokens").alias("single"))
    met = variants.join(alone, "l_returnflag", "left")
    line = F.when(c("l_linestatus") == "F", _string(c("l_returnflag"), ": single, ", c("tokens"), " tokens")).when(c("single").isNull(), _string(c("l_returnflag"), ": nothing to compare")).otherwise(_string(c("l_returnflag"), ": ", c("tokens"), " tokens against ", c("single")))
    return met.select(line.alias("line"))


def image_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether images match, the cheap test first: hash, then ink, then a formula's text; an error mark or missing bytes fail."""
    formula = c("p_size") % 2 == 0
    threshold = F.when(formula, 70.0).otherwise(80.0)
    plain, ink = c("p_retailprice") % 100, (c("p_partkey") % 100) / 100
    score = F.when(formula, plain).otherwise(F.greatest(plain, ink * 100))
    site = F.when(c("p_partkey") % 9 == 0, "[a] x").otherwise("x")
    decided = F.when(c("p_partkey") % 13 == 0, "missing").when(formula & shows_formula_error(site), "formula error").when(score >= threshold, "hash").when(ink >= 0.83, "ink").when(formula & (c("p_size") > 30), "read").otherwise("differs")
    return table(spark, d, "part").select("p_partkey", decided.alias("decided"))


def first_existing(spark: SparkSession, d: str) -> DataFrame:
    """The first of three candidate files that exists for each part."""
    part = table(spark, d, "part")
    files = part.filter("p_size > 20").select(_string(c("p_brand"), "/", c("p_size")).alias("path")).distinct()
    spread = part.select("p_partkey", F.posexplode(F.array(_string(c("p_brand"), "/", c("p_size")), _string(c("p_brand"), "/", c("p_size") + 10), _string("none/", c("p_partkey")))).alias("nth", "path"))
    best = spread.join(files, "path").groupBy("p_partkey").agg(F.min_by("path", "nth").alias("path"))
    return part.select("p_partkey").join(best, "p_partkey", "left")


def selected_targets(spark: SparkSession, d: str) -> DataFrame:
    """The first five nations by name among those asked for."""
    return selected(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", [n for n in range(25) if n != 7], 5, "n_name")


def note_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Notes among documents' lines: each opens with a marked line, the lines up to the next one are its body, one space between."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    opens = F.rlike("line", F.lit("^[A-Z][a-z]"))
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    noted = lines.withColumn("note", F.sum(opens.cast("long")).over(upto)).filter("note > 0").withColumn("opens", opens)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~c("opens"), F.struct("n", "line")))), lambda x: x["line"]), " ")
    return noted.groupBy("doc_id", "note").agg(F.sha2(body.cast("binary"), 256).alias("body"), F.count("*").alias("n_lines"))


QUERIES = {f.__name__: f for f in (division_or_first, deepest_owners, required_specs, leveled_end_pages, positioned_ordinals, markdown_epics, kept_verdicts, variant_lines, image_decisions, first_existing, selected_targets, note_bodies)}

_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
ORACLES = {
    "division_or_first": "SELECT e.event_id, coalesce(v.event_id, (SELECT first(f.event_id ORDER BY f.ts, f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'view')) AS view_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts",
    "deepest_owners": """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), k AS (SELECT k.user_id, k.ts, k.event_id, p.event_id AS up FROM (SELECT * FROM events WHERE event_type = 'click') k ASOF JOIN p ON k.user_id = p.user_id AND k.ts >= p.ts),
e AS (SELECT e.event_id, e.user_id, e.ts, p.event_id AS up FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts)
SELECT e.event_id, CASE WHEN k.event_id IS NOT NULL THEN 'c' || k.event_id WHEN e.up IS NOT NULL THEN 'p' || e.up END AS owner FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.up = k.up AND e.ts >= k.ts""",
    "required_specs": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "leveled_end_pages": """
WITH o AS (SELECT 'O' || o_orderkey AS node, 'C' || c_custkey AS parent, 'N' || c_nationkey AS top, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS page FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT parent AS node, top AS parent, min(page) AS page FROM o GROUP BY 1, 2), n AS (SELECT parent AS node, min(page) AS page FROM k GROUP BY 1),
ne AS (SELECT node, greatest(page, coalesce(lead(page) OVER (ORDER BY page, node) - 1, 20000)) AS e FROM n),
ke AS (SELECT k.node, greatest(page, coalesce(lead(page) OVER (PARTITION BY parent ORDER BY page, k.node) - 1, ne.e)) AS e FROM k JOIN ne ON k.parent = ne.node),
oe AS (SELECT o.node, greatest(page, coalesce(lead(page) OVER (PARTITION BY parent ORDER BY page, o.node) - 1, ke.e)) AS e FROM o JOIN ke ON o.parent = ke.node)
SELECT node, e::INT AS end_page FROM ne UNION ALL SELECT node, e::INT FROM ke UNION ALL SELECT node, e::INT FROM oe""",
    "positioned_ordinals": "SELECT l_orderkey, l_partkey, l_orderkey || '.Fig' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS key FROM lineitem",
    "markdown_epics": f"SELECT {_SLUG.format('p_brand')} AS epic, p_partkey AS number, p_name AS story, 2::BIGINT AS n_criteria, {_SLUG.format('p_type')} AS label FROM part",
    "kept_verdicts": """
WITH l AS (SELECT l_linenumber, l_partkey, min(l_returnflag) AS v, sum(l_quantity)::BIGINT AS t FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, v AS base FROM l WHERE l_linenumber = 1),
g AS (SELECT l_linenumber, sum(t)::BIGINT AS t, coalesce(bool_and(v = base), false) AS keeps, count(base) AS n FROM l LEFT JOIN b USING (l_partkey) GROUP BY 1)
SELECT first(l_linenumber ORDER BY t, l_linenumber) FILTER (WHERE keeps) AS best, count(*) FILTER (WHERE keeps) AS n_keeping, sum(n)::BIGINT AS judged_twice FROM g""",
    "variant_lines": """
WITH v AS (SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity)::BIGINT AS t FROM lineitem GROUP BY 1, 2), a AS (SELECT f, t AS single FROM v WHERE s = 'F')
SELECT CASE WHEN s = 'F' THEN f || ': single, ' || t || ' tokens' WHEN single IS NULL THEN f || ': nothing to compare' ELSE f || ': ' || t || ' tokens against ' || single END AS line FROM v LEFT JOIN a USING (f)""",
    "image_decisions": """
WITH s AS (SELECT *, p_retailprice % 100 AS plain, (p_partkey % 100) / 100 AS ink, p_size % 2 = 0 AS formula FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'missing' WHEN formula AND p_partkey % 9 = 0 THEN 'formula error' WHEN (formula AND plain >= 70) OR (NOT formula AND greatest(plain, ink * 100) >= 80) THEN 'hash' WHEN ink >= 0.83 THEN 'ink' WHEN formula AND p_size > 30 THEN 'read' ELSE 'differs' END AS decided FROM s""",
    "first_existing": """
WITH f AS (SELECT DISTINCT p_brand || '/' || p_size AS path FROM part WHERE p_size > 20)
SELECT p_partkey, CASE WHEN p_brand || '/' || p_size IN (SELECT path FROM f) THEN p_brand || '/' || p_size WHEN p_brand || '/' || (p_size + 10) IN (SELECT path FROM f) THEN p_brand || '/' || (p_size + 10) END AS path FROM part""",
    "selected_targets": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 7 ORDER BY n_name LIMIT 5",
    "note_bodies": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, regexp_matches(line, '^[A-Z][a-z]') AS opens, sum(regexp_matches(line, '^[A-Z][a-z]')::BIGINT) OVER (PARTITION BY doc_id ORDER BY n) AS note FROM l)
SELECT doc_id, note::BIGINT AS note, sha256(coalesce(string_agg(line, ' ' ORDER BY n) FILTER (WHERE NOT opens), '')) AS body, count(*) AS n_lines FROM m WHERE note > 0 GROUP BY 1, 2""",
}
