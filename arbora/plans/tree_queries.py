"""Keys, ordinals and roll-up over region, nation, customer, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators.tree import KeyRule, group_rank, keyed_level, keyed_levels, rolled_up
from arbora.operators.windows import end_pages, nearest_lower
from arbora.sources.staging import staged
from arbora.sources.tables import table

KINDS = ("signup", "view", "click", "purchase", "error")
RULES = {"region": KeyRule("root", scope=True), "nation": KeyRule("child"), "customer": KeyRule("ordinal", "c"), "order": KeyRule("child")}


def _levels(spark: SparkSession, d: str) -> list[DataFrame]:
    def level(name: str, node: str, parent: str | None, kind: str, identifier) -> DataFrame:
        rows = table(spark, d, name)
        up = F.lit(None).cast("long") if parent is None else F.col(parent).cast("long")
        return rows.select(F.col(node).cast("long").alias("node_id"), up.alias("parent_id"), F.lit(kind).alias("type"), identifier.alias("identifier"), F.col(node).cast("long").alias("ord"))

    return [
        level("region", "r_regionkey", None, "region", F.col("r_name")),
        level("nation", "n_nationkey", "n_regionkey", "nation", F.col("n_name")),
        level("customer", "c_custkey", "c_nationkey", "customer", F.lit("")),
        level("orders", "o_orderkey", "o_custkey", "order", F.col("o_orderkey").cast("string")),
    ]


KEYS_SQL = """
r AS (SELECT r_regionkey AS id, r_name AS key FROM region),
n AS (SELECT n_nationkey AS id, r.key AS region_key, r.key || '.' || n_name AS key FROM nation JOIN r ON n_regionkey = r.id),
c AS (SELECT c_custkey AS id, n.region_key, n.key AS nation_key, n.key || '.c' || row_number() OVER (PARTITION BY n.key ORDER BY c_custkey) AS key FROM customer JOIN n ON c_nationkey = n.id),
o AS (SELECT o_orderkey AS id, c.region_key, c.nation_key, c.key AS customer_key, c.key || '.' || o_orderkey AS key FROM orders JOIN c ON o_custkey = c.id)"""


def tree_unified_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every node of four levels."""
    levels = keyed_levels(_levels(spark, d), RULES)
    out = levels[0].select("type", "node_id", "key")
    for level in levels[1:]:
        out = out.unionByName(level.select("type", "node_id", "key"))
    return out.withColumnRenamed("key", "unified_key")


def tree_duplicate_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Customers keyed by market segment under their nation: every repeat of a key gets a running suffix."""
    region, nation, customer, _ = _levels(spark, d)
    segment = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("segment"))
    named = customer.join(segment, "node_id").withColumn("identifier", F.col("segment")).drop("segment")
    rules = RULES | {"customer": KeyRule("child")}
    keyed = keyed_levels([region, nation, named], rules)[2]
    return keyed.select(F.col("node_id").alias("c_custkey"), F.col("key").alias("unified_key"))


def tree_scoped_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Orders counted within their region, in walk order, by ranks that no single task holds."""
    region, nation, customer, orders = _levels(spark, d)
    walk = orders.join(customer.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("n")), "parent_id").join(F.broadcast(nation.select(F.col("node_id").alias("n"), F.col("parent_id").alias("r"))), "n")
    ranked = group_rank(walk.select("node_id", "r", "n", "parent_id"), ["r"], ["n", "parent_id", "node_id"], "nth")
    return ranked.select(F.col("node_id").alias("o_orderkey"), F.col("r").alias("r_regionkey"), F.col("nth").cast("long").alias("nth"))


def scope_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The scope of a citation is that of the first node, in walk order, that has it: brands over parts by size."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_size", "p_partkey").alias("scope_size"), F.min("p_partkey").alias("first_part"))


def image_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Images (lineitems that are not returned) numbered within the scope of their order."""
    rows = table(spark, d, "lineitem").filter("l_returnflag <> 'R'")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit(".Fig"), nth.cast("string")).alias("image_key"))


def reconcile_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    """Two keyed trees joined on their keys, orders compared by content, the outcome rolled up to every ancestor.

    The second tree lacks every 11th order and holds another price for every 7th."""
    region, nation, customer, orders = keyed_levels(_levels(spark, d), RULES)
    content = table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.concat_ws("|", "o_orderpriority", F.col("o_orderstatus")).alias("content"))
    left = staged(orders.select("node_id", "parent_id", "key").join(content, "node_id"))
    other = F.when(F.col("node_id") % 7 == 0, F.concat("content", F.lit("*"))).otherwise(F.col("content"))
    right = left.filter("node_id % 11 <> 0").select("key", other.alias("other"))
    compared = left.join(right, "key", "left").withColumn("ok", F.coalesce(F.col("content") == F.col("other"), F.lit(False)))
    up = customer.select(F.col("node_id").alias("parent_id"), F.col("key").alias("customer_key"), F.col("parent_key").alias("nation_key"), F.col("root_key").alias("region_key"))
    leaves = compared.join(up, "parent_id").select("region_key", "nation_key", "customer_key", F.col("key").alias("order_key"), "ok")
    kind = F.element_at(F.array(*map(F.lit, ("region", "nation", "customer", "order"))), F.col("depth") + 1)
    return rolled_up(leaves, ["region_key", "nation_key", "customer_key", "order_key"]).select(F.col("key").alias("unified_key"), kind.alias("type"), "ok", F.col("n_failed").alias("n_failed_leaves"))


def rank_stack_parent(spark: SparkSession, d: str) -> DataFrame:
    """Parents by ranks within a user's events: the nearest earlier event of lower rank, ranks from the kinds of events."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    rows = table(spark, d, "events").select("user_id", "event_id", rank.alias("rank"))
    parent = nearest_lower("rank", list(range(1, len(KINDS) + 1)), "event_id", ["user_id"])
    return rows.select("event_id", parent.alias("parent_event"))


def end_page_lead(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer by date: each ends a day before the next begins, the last with the customer's last day."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("page"))
    last = F.lit(4000)
    return end_pages(rows, ["o_custkey"], ["page", "o_orderkey"], "page", last).select("o_orderkey", "page", F.col("end_page").cast("int").alias("end_page"))


def inherited_attribute(spark: SparkSession, d: str) -> DataFrame:
    """A customer lives on the page of its nearest ancestor-or-self that has one."""
    customer, nation, region = (table(spark, d, n) for n in ("customer", "nation", "region"))
    own = F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("customer "), F.col("c_custkey").cast("string")))
    near = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("nation "), F.col("n_name")))
    far = F.when(F.col("r_regionkey") != 2, F.concat(F.lit("region "), F.col("r_name")))
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", F.coalesce(own, near, far).alias("page")).filter("page IS NOT NULL")


def visible_children(spark: SparkSession, d: str) -> DataFrame:
    """Hidden nations splice their customers up: the nearest visible host of each customer."""
    customer, nation, region = (table(spark, d, n) for n in ("customer", "nation", "region"))
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    hidden = F.length("n_name") > 7
    return joined.groupBy(F.when(hidden, F.col("r_name")).otherwise(F.col("n_name")).alias("host")).agg(F.count("*").alias("n_children"), F.min("c_custkey").alias("first_child"))


QUERIES = {f.__name__: f for f in (tree_unified_keys, tree_duplicate_suffix, tree_scoped_ordinals, scope_first_wins, image_numbering, reconcile_rollup_all, rank_stack_parent, end_page_lead, inherited_attribute, visible_children)}
ORACLES = {
    "tree_unified_keys": f"WITH {KEYS_SQL} SELECT 'region' AS type, id::BIGINT AS node_id, key AS unified_key FROM r UNION ALL SELECT 'nation', id, key FROM n UNION ALL SELECT 'customer', id, key FROM c UNION ALL SELECT 'order', id, key FROM o",
    "tree_duplicate_suffix": """
WITH k AS (SELECT c_custkey, n_nationkey, r_name || '.' || n_name || '.' || c_mktsegment AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_nationkey, c_custkey) AS i FROM k)
SELECT c_custkey, CASE WHEN i = 1 THEN key ELSE key || '~' || i END AS unified_key FROM m""",
    "tree_scoped_ordinals": "SELECT o_orderkey, n_regionkey::BIGINT AS r_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey, o_orderkey) AS nth FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "scope_first_wins": "SELECT p_brand, first(p_size ORDER BY p_partkey) AS scope_size, min(p_partkey) AS first_part FROM part GROUP BY p_brand",
    "image_numbering": "SELECT l_orderkey, l_linenumber, l_orderkey || '.Fig' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS image_key FROM lineitem WHERE l_returnflag <> 'R'",
    "reconcile_rollup_all": f"""
WITH {KEYS_SQL},
content AS (SELECT o.*, o_orderpriority || '|' || o_orderstatus AS mine FROM o JOIN orders ON o_orderkey = o.id),
leaf AS (SELECT region_key, nation_key, customer_key, key, CASE WHEN id % 11 = 0 THEN false ELSE id % 7 <> 0 END AS ok FROM content),
up AS (SELECT region_key AS k, 'region' AS type, ok FROM leaf UNION ALL SELECT nation_key, 'nation', ok FROM leaf UNION ALL SELECT customer_key, 'customer', ok FROM leaf UNION ALL SELECT key, 'order', ok FROM leaf)
SELECT k AS unified_key, type, bool_and(ok) AS ok, count(*) FILTER (WHERE NOT ok) AS n_failed_leaves FROM up GROUP BY k, type""",
    "rank_stack_parent": """
WITH e AS (SELECT user_id, event_id, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS rank FROM events)
SELECT a.event_id, max(b.event_id) AS parent_event FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.rank < a.rank GROUP BY a.event_id""",
    "end_page_lead": """
WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS page FROM orders)
SELECT o_orderkey, page, greatest(page, coalesce(lead(page) OVER (PARTITION BY o_custkey ORDER BY page, o_orderkey) - 1, 4000))::INT AS end_page FROM o""",
    "inherited_attribute": """
SELECT * FROM (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 9000 THEN 'customer ' || c_custkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'nation ' || n_name END, CASE WHEN r_regionkey <> 2 THEN 'region ' || r_name END) AS page
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE page IS NOT NULL""",
    "visible_children": "SELECT CASE WHEN length(n_name) > 7 THEN r_name ELSE n_name END AS host, count(*) AS n_children, min(c_custkey) AS first_child FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
}
