"""Joins on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.numbers import overlaps
from arbora.operators.joins import as_of, longest_prefix, not_yet, nth_occurrence, paired_by_stem, unique_key_pairs, upserted, with_override, without_overlap
from arbora.operators.windows import zip_equal_groups
from arbora.sources.tables import table


def reconcile_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their counterparts: overrides move some keys on by one and say of others that there is none."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    overrides = orders.filter("key % 5 = 0").select("key", F.when(F.col("key") % 10 != 0, F.col("key") + 1).alias("partner"))
    partnered = with_override(orders, overrides, "key")
    right = orders.select(F.col("key").alias("partner_key"), F.col("o_totalprice").alias("partner_price"))
    joined = partnered.join(right, "partner_key", "left")
    return joined.select("key", "partner_key", F.coalesce(F.col("partner_price") == F.col("o_totalprice"), F.lit(False)).alias("matches"))


def changed_counterparts(spark: SparkSession, d: str) -> DataFrame:
    """Only counterparts that differ from the key itself are written out."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    overrides = orders.filter("key % 5 = 0").select("key", F.when(F.col("key") % 10 != 0, F.col("key") + 1).alias("partner"))
    return with_override(orders, overrides, "key").filter(~F.col("key").eqNullSafe(F.col("partner_key")))


def full_outer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers paired by a stem of their numbers."""
    left = table(spark, d, "customer").select(F.substring("c_name", -6, 6).alias("stem"), "c_custkey")
    right = table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") * 20).cast("string"), 6, "0").alias("stem"), "s_suppkey")
    return paired_by_stem(left, right, "stem")


def pairs_with_right_only(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the counts of their orders, and of order keys that are no customer's."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    right = table(spark, d, "orders").groupBy((F.col("o_custkey") + 100).alias("key")).agg(F.count("*").alias("n_orders"))
    both = left.join(right, "key", "left").withColumn("side", F.when(F.col("n_orders").isNull(), "left only").otherwise("both"))
    return both.unionByName(right.join(left, "key", "left_anti").select("key", F.lit(None).cast("string").alias("c_mktsegment"), "n_orders", F.lit("right only").alias("side")))


def _dotted_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = F.regexp_extract("url", r"://([^/?#]*)([^?#]*)", 1), F.regexp_extract("url", r"://([^/?#]*)([^?#]*)", 2)
    host = F.array_join(F.reverse(F.split(parts[0], r"\.")), ".")
    rest = F.translate(F.regexp_replace(F.regexp_replace(parts[1], "^/+|/+$", ""), r"\.", "_"), "/", ".")
    return table(spark, d, "pages").select("page_id", F.concat(host, F.lit("."), rest).alias("path"))


def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """Pages owned by the longest known prefix of their dotted address; known are host and language prefixes met twice."""
    pages = _dotted_pages(spark, d)
    known = pages.select(F.explode(F.array(F.substring_index("path", ".", 3), F.substring_index("path", ".", 4))).alias("owner")).groupBy("owner").count().filter("count >= 2")
    return longest_prefix(pages, "path", known).select("page_id", "owner", "exact")


def nearest_anchor_exact(spark: SparkSession, d: str) -> DataFrame:
    """The nearest anchor of each page among the addresses of even pages, and whether it is the page's own."""
    pages = _dotted_pages(spark, d)
    anchors = pages.filter("page_id % 2 = 0").select(F.explode(F.array("path", F.substring_index("path", ".", 3))).alias("owner"))
    return longest_prefix(pages, "path", anchors, "anchor").select("page_id", "anchor", "exact")


def asof_owner(spark: SparkSession, d: str) -> DataFrame:
    """Errors owned by the user's latest view at or before them."""
    events = table(spark, d, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(errors, views, ["user_id"], "ts", "view_id", "view_id").select("event_id", "view_id")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_discount") * 400
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 12).alias("y1"))


def _other_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_l_orderkey"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))


def spatial_anti_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on a page (an order) that overlap no returned box there."""
    boxes = _boxes(spark, d)
    kept = without_overlap(boxes.filter("l_returnflag <> 'R'"), _other_boxes(boxes), "l_orderkey", overlaps("", "o_"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


def point_in_box_anti(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose centre lies in no returned box of the page."""
    boxes = _boxes(spark, d)
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("o_x0"), F.col("o_x1")) & y.between(F.col("o_y0"), F.col("o_y1"))
    return without_overlap(boxes.filter("l_returnflag <> 'R'"), _other_boxes(boxes), "l_orderkey", inside).select("l_orderkey", "l_linenumber", "l_partkey")


def band_tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """The first returned line of the page whose quantity and discount are within tolerance."""
    boxes = _boxes(spark, d)
    others = boxes.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("other_part"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    near = boxes.filter("l_returnflag = 'A'").join(others, "l_orderkey").filter((F.abs(F.col("x0") - F.col("ox")) <= 5) & (F.abs(F.col("y0") - F.col("oy")) <= 8))
    return near.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("other_part").alias("first_part"))


def ordinal_zip_equal_groups(spark: SparkSession, d: str) -> DataFrame:
    """Returned and accepted lines of an order paired in order where there are as many of both."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    left, right = (rows.filter(F.col("l_returnflag") == f).select("l_orderkey", "l_partkey") for f in ("R", "A"))
    return zip_equal_groups(left, right, ["l_orderkey"], ["l_partkey"], ["l_partkey"]).filter("left_l_partkey <> right_l_partkey")


def nth_occurrence_join(spark: SparkSession, d: str) -> DataFrame:
    """A user's n-th click takes the n-th view."""
    events = table(spark, d, "events")
    clicks, views = (events.filter(F.col("event_type") == t).select("user_id", F.col("event_id").alias(f"{t}_id")) for t in ("click", "view"))
    return nth_occurrence(clicks, views, ["user_id"], ["click_id"], ["view_id"]).select("click_id", "view_id")


def unique_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers whose balance, in whole units, is unique on both sides."""
    left = table(spark, d, "customer").select(F.floor("c_acctbal").alias("balance"), "c_custkey")
    right = table(spark, d, "supplier").select(F.floor("s_acctbal").alias("balance"), "s_suppkey")
    return unique_key_pairs(left, right, "balance")


def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts joined to figures of their brand by the number behind its mark."""
    part = table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_brand", "#"), 2).alias("number"))
    figures = part.groupBy("number").agg(F.count("*").alias("n_parts"))
    return part.join(figures, "number").select("p_partkey", "number", "n_parts")


def owner_precedence(spark: SparkSession, d: str) -> DataFrame:
    """An order's owner: the customer of large orders, else the nation, else the region, each by its own join."""
    orders, customer, nation = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    direct = customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("direct"))
    joined = orders.select("o_orderkey", "o_custkey").join(direct, "o_custkey", "left").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    named = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joined.join(F.broadcast(named), "c_nationkey", "left").select("o_orderkey", F.coalesce("direct", "n_name", F.lit("none")).alias("owner"))


def short_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers for whom fewer orders are open than were placed: rendered against expected."""
    orders = table(spark, d, "orders")
    expected = orders.groupBy("o_custkey").agg(F.count("*").alias("expected"))
    rendered = orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("rendered"))
    return expected.join(rendered, "o_custkey", "left").select("o_custkey", "expected", F.coalesce("rendered", F.lit(0)).cast("long").alias("rendered")).filter("rendered < expected")


def cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a cached verdict and those still to judge."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("key"))
    cache = part.filter("p_partkey % 3 = 0").groupBy("key").agg(F.min("p_partkey").alias("verdict"))
    return part.join(cache, "key", "left").select("p_partkey", "verdict", F.when(F.col("verdict").isNull(), "miss").otherwise("hit").alias("state"))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A cache of order statuses with a day's changes in place."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("judged").alias("o_orderstatus"))
    return upserted(orders, changes, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def idempotent_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers for whom no issue was created yet: those without an order."""
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return not_yet(customer, table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("key")), ["key"])


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers and suppliers: in both, on one side only."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).distinct()
    parts = (c.intersect(s), "both"), (c.exceptAll(s), "left"), (s.exceptAll(c), "right")
    out = [p.withColumn("side", F.lit(n)) for p, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def map_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Balances of customers overlaid by those of suppliers with the same number."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("a"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("b"))
    return left.join(right, "key", "full_outer").select("key", F.coalesce("b", "a").alias("balance"))


QUERIES = {f.__name__: f for f in (reconcile_left_join, changed_counterparts, full_outer_pairs, pairs_with_right_only, longest_prefix_owner, nearest_anchor_exact, asof_owner, spatial_anti_overlap, point_in_box_anti, band_tolerance_match, ordinal_zip_equal_groups, nth_occurrence_join, unique_key_join, prefix_lookup, owner_precedence, short_tables, cache_split, cache_upsert, idempotent_anti_join, key_sets, map_overlay)}

_PATHS = r"""paths AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '.')), '.') || '.' ||
  replace(replace(regexp_replace(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '^/+|/+$', '', 'g'), '.', '_'), '/', '.') AS path FROM pages)"""
_FIRST = "array_to_string(string_split(path, '.')[1:{n}], '.')"
_BEST = """best AS (SELECT page_id, max(owner ORDER BY length(owner)) AS o, max(length(owner)) AS len FROM paths JOIN known ON path = owner OR starts_with(path, owner || '.') GROUP BY page_id)"""
_BOXES = "boxes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity AS x0, l_discount * 400 AS y0, l_quantity + 8 AS x1, l_discount * 400 + 12 AS y1 FROM lineitem)"
_OVERRIDE = "o AS (SELECT o_orderkey AS key, o_totalprice AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS partner_key FROM orders)"
ORACLES = {
    "reconcile_left_join": f"WITH {_OVERRIDE} SELECT o.key, o.partner_key, coalesce(p.price = o.price, false) AS matches FROM o LEFT JOIN o p ON p.key = o.partner_key",
    "changed_counterparts": f"WITH {_OVERRIDE} SELECT key, partner_key FROM o WHERE partner_key IS DISTINCT FROM key",
    "full_outer_pairs": """
WITH c AS (SELECT right(c_name, 6) AS stem, c_custkey FROM customer), s AS (SELECT lpad((s_suppkey * 20)::VARCHAR, 6, '0') AS stem, s_suppkey FROM supplier)
SELECT coalesce(c.stem, s.stem) AS stem, c_custkey, s_suppkey, CASE WHEN c.stem = s.stem THEN 'matched' WHEN s.stem IS NULL THEN 'left only' ELSE 'right only' END AS status FROM c FULL JOIN s ON c.stem = s.stem""",
    "pairs_with_right_only": """
WITH r AS (SELECT o_custkey + 100 AS key, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, r.key) AS key, c_mktsegment, n_orders, CASE WHEN c_custkey IS NULL THEN 'right only' WHEN r.key IS NULL THEN 'left only' ELSE 'both' END AS side FROM customer FULL JOIN r ON c_custkey = r.key""",
    "longest_prefix_owner": f"""
WITH {_PATHS}, known AS (SELECT owner FROM (SELECT {_FIRST.format(n=3)} AS owner FROM paths UNION ALL SELECT {_FIRST.format(n=4)} FROM paths) GROUP BY owner HAVING count(*) >= 2),
{_BEST} SELECT page_id, left(path, len) AS owner, len IS NOT NULL AND len = length(path) AS exact FROM paths LEFT JOIN best USING (page_id)""",
    "nearest_anchor_exact": f"""
WITH {_PATHS}, known AS (SELECT DISTINCT owner FROM (SELECT path AS owner FROM paths WHERE page_id % 2 = 0 UNION ALL SELECT {_FIRST.format(n=3)} FROM paths WHERE page_id % 2 = 0)),
{_BEST} SELECT page_id, left(path, len) AS anchor, len IS NOT NULL AND len = length(path) AS exact FROM paths LEFT JOIN best USING (page_id)""",
    "asof_owner": "SELECT e.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts",
    "spatial_anti_overlap": f"WITH {_BOXES} SELECT l_orderkey, l_linenumber, l_partkey FROM boxes a WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)",
    "point_in_box_anti": f"WITH {_BOXES} SELECT l_orderkey, l_linenumber, l_partkey FROM boxes a WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)",
    "band_tolerance_match": f"WITH {_BOXES} SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, min(b.l_partkey) AS first_part FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND abs(a.x0 - b.x0) <= 5 AND abs(a.y0 - b.y0) <= 8 GROUP BY 1, 2, 3",
    "ordinal_zip_equal_groups": """
WITH n AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem)
SELECT a.l_orderkey, a.l_partkey AS left_l_partkey, b.l_partkey AS right_l_partkey FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.i = b.i AND a.c = b.c WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_partkey <> b.l_partkey""",
    "nth_occurrence_join": """
WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)
SELECT a.event_id AS click_id, b.event_id AS view_id FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.i = b.i AND b.event_type = 'view' WHERE a.event_type = 'click'""",
    "unique_key_join": """
WITH c AS (SELECT floor(c_acctbal)::BIGINT AS balance, any_value(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1), s AS (SELECT floor(s_acctbal)::BIGINT AS balance, any_value(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1)
SELECT balance, c_custkey, s_suppkey FROM c JOIN s USING (balance)""",
    "prefix_lookup": "SELECT p_partkey, string_split(p_brand, '#')[2] AS number, count(*) OVER (PARTITION BY p_brand) AS n_parts FROM part",
    "owner_precedence": "SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'c' || c_custkey END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'none') AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "short_tables": "SELECT o_custkey, count(*) AS expected, count(*) FILTER (WHERE o_orderstatus = 'O') AS rendered FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') < count(*)",
    "cache_split": """
WITH c AS (SELECT p_brand || '|' || p_type AS key, min(p_partkey) AS verdict FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT p_partkey, verdict, CASE WHEN verdict IS NULL THEN 'miss' ELSE 'hit' END AS state FROM part LEFT JOIN c ON key = p_brand || '|' || p_type""",
    "cache_upsert": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'judged' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "idempotent_anti_join": "SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "key_sets": """
WITH c AS (SELECT DISTINCT c_nationkey AS key FROM customer), s AS (SELECT DISTINCT s_nationkey AS key FROM supplier)
SELECT coalesce(c.key, s.key) AS key, CASE WHEN c.key = s.key THEN 'both' WHEN s.key IS NULL THEN 'left' ELSE 'right' END AS side FROM c FULL JOIN s ON c.key = s.key""",
    "map_overlay": "SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_acctbal, c_acctbal) AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
}
