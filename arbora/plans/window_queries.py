"""Ordered operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators.windows import apportioned, blocks, islands, merged_boundaries, next_value, packed, systematic_sample
from arbora.sources.tables import table


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, line) of every document."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are not blank, numbered within their document."""
    kept = document_lines(spark, d).filter(F.trim("line") != "")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return kept.select("doc_id", n.alias("n"), F.length("line").alias("length"))


def islands_sentences(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in groups that begin with a signup; what stands before the first is dropped."""
    events = table(spark, d, "events")
    grouped = islands(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "sentence")
    return grouped.groupBy("user_id", "sentence").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " ").alias("content"))


def islands_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a user's events from a view until an error."""
    events = table(spark, d, "events")
    inside = blocks(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "error")
    return inside.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def lookahead_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """The next purchase after each event of a user."""
    found = next_value(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], ["ts", "event_id"])
    return table(spark, d, "events").select("event_id", found.alias("next_purchase"))


def trailing_line(spark: SparkSession, d: str) -> DataFrame:
    """Last lines of documents, and whether they are digits alone."""
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    rows = document_lines(spark, d).withColumn("last", last).filter("line_no = last")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.rlike("line", F.lit(r"^[0-9]+$")).alias("page_number"))


def token_bands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events of one kind."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.lag("event_type").over(order)
    rows = table(spark, d, "events").withColumn("new", F.when(changed == F.col("event_type"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


def anchor_bound(spark: SparkSession, d: str) -> DataFrame:
    """Each order of a customer reaches until the customer's next one."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", following.alias("below"))


def boundary_merge_fold(spark: SparkSession, d: str) -> DataFrame:
    """Column boundaries of a page: an order's quantities, merged within two of the last one kept."""
    values = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return values.select("l_orderkey", F.array_join(F.transform(merged_boundaries(F.col("v")), lambda x: x.cast("int").cast("string")), ",").alias("boundaries"))


def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders packed in key order, four at most and within a budget of price."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("tokens"))
    out = packed(rows, ["o_custkey"], "o_orderkey", "tokens", 4, 600_000)
    return out.select("o_custkey", "o_orderkey", F.col("batch").cast("long").alias("batch"))


def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """A hundred units shared out over the orders of a customer by price, to the last unit."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("w"), F.lit(100).cast("long").alias("total"))
    return apportioned(rows, ["o_custkey"], "o_orderkey", "w", "total").select("o_orderkey", "share")


def sliding_budget(spark: SparkSession, d: str) -> DataFrame:
    """Requests and tokens a user sent in the hour up to each event, and whether either budget was exceeded."""
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = Window.partitionBy("user_id").orderBy(second).rangeBetween(-3_600_000_000 + 1, 0)
    rows = table(spark, d, "events").select("event_id", F.count("*").over(hour).alias("requests"), F.sum(F.floor("value").cast("long")).over(hour).alias("tokens"))
    return rows.withColumn("over", (F.col("requests") > 2) | (F.col("tokens") > 100))


def systematic_sample_orders(spark: SparkSession, d: str) -> DataFrame:
    """Forty orders spread evenly over all orders by key."""
    return systematic_sample(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 40)


def limit_keep_rest(spark: SparkSession, d: str) -> DataFrame:
    """Of a customer's orders the three dearest go to judging, the others are recorded as skipped."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.when(rank <= 3, "judge").otherwise("skipped").alias("route"))


def revision_asof(spark: SparkSession, d: str) -> DataFrame:
    """A user's state as of a moment: the latest revision by time and number; users whose latest is an error are gone."""
    then = table(spark, d, "events").filter("ts <= TIMESTAMP '2024-01-10 00:00:00'")
    latest = then.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r"))
    return latest.filter("r.event_type <> 'error'").select("user_id", "r.event_id", "r.event_type", "r.value")


def exactly_once_validate(spark: SparkSession, d: str) -> DataFrame:
    """Of the ids 1 to 7 of an order, those answered exactly once; others are missing."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    once = rows.filter("n = 1").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("ids"))
    everyone = rows.select("l_orderkey").distinct().join(once, "l_orderkey", "left")
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(7)), ids)
    return everyone.select("l_orderkey", F.array_join(F.array_sort(missing).cast("array<string>"), ",").alias("missing"))


QUERIES = {f.__name__: f for f in (line_scan, islands_sentences, islands_blocks, lookahead_first_nonnull, trailing_line, token_bands, anchor_bound, boundary_merge_fold, greedy_pack, largest_remainder, sliding_budget, systematic_sample_orders, limit_keep_rest, revision_asof, exactly_once_validate)}

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
ORACLES = {
    "line_scan": f"WITH {_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, length(line) AS length FROM lines WHERE trim(line, ' ') <> ''",
    "islands_sentences": """
WITH g AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sentence FROM events)
SELECT user_id, sentence, count(*) AS n, string_agg(event_type, ' ' ORDER BY ts, event_id) AS content FROM g WHERE sentence > 0 GROUP BY 1, 2""",
    "islands_blocks": """
WITH g AS (SELECT *, sum((event_type = 'view')::INT) OVER w AS block, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS v, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, block, count(*) AS n, min(event_id) AS first_event FROM g WHERE v IS NOT NULL AND (e IS NULL OR e < v) GROUP BY 1, 2""",
    "lookahead_first_nonnull": "SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events",
    "trailing_line": f"WITH {_LINES}, m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, line_no, regexp_full_match(line, '[0-9]+') AS page_number FROM m WHERE line_no = last",
    "token_bands": """
WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, count(*) FILTER (WHERE before IS DISTINCT FROM event_type) OVER (PARTITION BY user_id ORDER BY i) AS run FROM g)
SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "anchor_bound": "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS below FROM orders",
    "boundary_merge_fold": """
WITH RECURSIVE v AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, q, 1 AS i, [q[1]] AS kept FROM v UNION ALL SELECT l_orderkey, q, i + 1, CASE WHEN q[i + 1] - kept[-1] > 2 THEN list_append(kept, q[i + 1]) ELSE kept END FROM f WHERE i < len(q))
SELECT l_orderkey, array_to_string(list_transform(kept, lambda x: x::INT), ',') AS boundaries FROM f WHERE i = len(q)""",
    "greedy_pack": """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
p AS (SELECT o_custkey, o_orderkey, i, 0::BIGINT AS batch, 1 AS items, t AS used FROM o WHERE i = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, CASE WHEN items >= 4 OR used + t > 600000 THEN batch + 1 ELSE batch END, CASE WHEN items >= 4 OR used + t > 600000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 4 OR used + t > 600000 THEN t ELSE used + t END
FROM p JOIN o ON o.o_custkey = p.o_custkey AND o.i = p.i + 1)
SELECT o_custkey, o_orderkey, batch FROM p""",
    "largest_remainder": """
WITH w AS (SELECT o_custkey, o_orderkey, 100 * floor(o_totalprice)::BIGINT / sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey) AS exact FROM orders),
f AS (SELECT *, 100 - sum(floor(exact)::BIGINT) OVER (PARTITION BY o_custkey) AS left_over, row_number() OVER (PARTITION BY o_custkey ORDER BY exact - floor(exact) DESC, o_orderkey) AS i FROM w)
SELECT o_orderkey, floor(exact)::BIGINT + CASE WHEN i <= left_over THEN 1 ELSE 0 END AS share FROM f""",
    "sliding_budget": """
WITH s AS (SELECT event_id, count(*) OVER w AS requests, sum(floor(value)::BIGINT) OVER w::BIGINT AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
SELECT *, requests > 2 OR tokens > 100 AS over FROM s""",
    "systematic_sample_orders": """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders)
SELECT o_orderkey FROM n WHERE i IN (SELECT (k * (SELECT count(*) FROM orders)) // 40 FROM range(40) t(k))""",
    "limit_keep_rest": "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3 THEN 'judge' ELSE 'skipped' END AS route FROM orders",
    "revision_asof": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00')
SELECT user_id, event_id, event_type, value FROM r WHERE i = 1 AND event_type <> 'error'""",
    "exactly_once_validate": """
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), once AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)
SELECT o.l_orderkey, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (WHERE once.l_linenumber IS NULL), '') AS missing FROM o CROSS JOIN range(1, 8) t(i) LEFT JOIN once ON once.l_orderkey = o.l_orderkey AND once.l_linenumber = i GROUP BY 1""",
}
