"""Aggregations and reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import duration
from arbora.sources.tables import table

VERDICTS = ("view", "click", "purchase", "error", "signup", "refund")


def located_report(spark: SparkSession, d: str) -> DataFrame:
    """Events with and without a small value, by kind."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 10).alias("located"), F.count_if(F.col("value") >= 10).alias("unlocated"))


def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every verdict of the enumeration, zeros kept."""
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    everyone = spark.createDataFrame([(v,) for v in VERDICTS], "event_type string")
    return everyone.join(counted, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def null_poison_sum(spark: SparkSession, d: str) -> DataFrame:
    """A user's spend, unknown as soon as one part of it is."""
    cost = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long"))
    rows = table(spark, d, "events").withColumn("cost", F.when((F.col("event_type") == "error") & (F.col("value") < 30), F.lit(0)).otherwise(cost))
    return rows.groupBy("user_id").agg(F.when(F.count_if(F.col("cost").isNull()) > 0, F.lit(None)).otherwise(F.sum("cost")).alias("spend"))


def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Average and longest value, count and rate of each kind of event, and the whole as text."""
    grouped = table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("longest"), F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))
    return grouped.select("event_type", "n", "longest", F.round(F.try_divide("total", "n"), 6).alias("average"), F.try_divide(F.col("n") * 60.0, F.col("total")).alias("per_minute"), duration(F.col("total").cast("double")).alias("total_text"))


def agreement_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents both label sets judge, the share that agree."""
    labels = table(spark, d, "labels")
    left = labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("a"))
    right = labels.filter("toxic IS NOT NULL").select("doc_id", (1 - F.col("toxic")).alias("b"))
    return left.join(right, "doc_id").agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(0.0)).alias("agreement"), F.count("*").alias("judged"))


def recommend_min_by(spark: SparkSession, d: str) -> DataFrame:
    """Of each part type the cheapest brand all of whose parts are of at least size three."""
    by_brand = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.bool_and(F.col("p_size") >= 3).alias("keeps"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("tokens"))
    return by_brand.filter("keeps").groupBy("p_type").agg(F.min(F.struct("tokens", "p_brand")).alias("best")).select("p_type", F.col("best.p_brand").alias("p_brand"), F.col("best.tokens").alias("tokens"))


def scale_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """Measured over estimated tokens by return flag, and a suggestion where they differ by more than 15 percent."""
    sums = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("real"), F.sum(F.col("l_linenumber") * 7).alias("guess"))
    ratio = F.col("real") / F.col("guess")
    return sums.select("l_returnflag", F.round(ratio, 6).alias("scale"), (F.abs(ratio - 1) > 0.15).alias("suggest"))


def dry_run_plan(spark: SparkSession, d: str) -> DataFrame:
    """Counts, tokens and calls of routed parts: those of high price are settled, the others judged ten to a call."""
    routed = table(spark, d, "part").withColumn("route", F.when(F.col("p_retailprice") >= 1500, "settled").otherwise("judge"))
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.sum("p_size").alias("tokens"), F.ceil(F.count("*") / 10).alias("calls"))


def first_error(spark: SparkSession, d: str) -> DataFrame:
    """The first error of each user."""
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.min_by("props", F.struct("ts", "event_id")).alias("message"))


def table_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Header and body rows of each order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("header_rows"), F.count_if(F.col("l_linenumber") > 1).alias("body_rows"), F.count("*").alias("n_rows"))


def first_seen_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct kinds of a user's events in order of first appearance."""
    firsts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


def box_union(spark: SparkSession, d: str) -> DataFrame:
    """The box around an order's lines."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max(F.col("l_quantity") + 5).alias("x1"), F.max("l_tax").alias("y1"))


def median_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Midway between the medians of an order's returned and other quantities, null where one side is missing."""
    flag = F.col("l_returnflag") == "R"
    medians = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.median(F.when(flag, F.col("l_quantity"))).alias("a"), F.median(F.when(~flag, F.col("l_quantity"))).alias("b"))
    return medians.select("l_orderkey", ((F.col("a") + F.col("b")) / 2).alias("threshold"))


def dominant_by_weight(spark: SparkSession, d: str) -> DataFrame:
    """Of a nation's customers the segment with the greatest balance, ties by name."""
    weights = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("w"))
    return weights.groupBy("c_nationkey").agg(F.min(F.struct(-F.col("w"), "c_mktsegment")).alias("x")).select("c_nationkey", F.col("x.c_mktsegment").alias("segment"))


def clipped_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order's rules, clipped to the column from 10 to 40, cover half of it."""
    clipped = F.greatest(F.lit(0.0), F.least(F.col("l_quantity") + 6, F.lit(40.0)) - F.greatest("l_quantity", F.lit(10.0)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(clipped) >= 15).alias("across"))


def citation_set(spark: SparkSession, d: str) -> DataFrame:
    """The set of citations: brands and types, once each."""
    part = table(spark, d, "part")
    return part.select(F.col("p_brand").alias("citation")).union(part.select("p_type")).distinct()


QUERIES = {f.__name__: f for f in (located_report, verdict_tally, null_poison_sum, timing_stats, agreement_ratio, recommend_min_by, scale_suggestion, dry_run_plan, first_error, table_row_counts, first_seen_distinct, box_union, median_threshold, dominant_by_weight, clipped_coverage, citation_set)}

_TEXT = """CASE WHEN round_even(total, 1) < 60 THEN total || ' s' WHEN total // 3600 > 0 THEN (total // 3600) || 'h ' || lpad((total % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((total % 60)::VARCHAR, 2, '0') || 's' ELSE (total // 60) || 'm ' || lpad((total % 60)::VARCHAR, 2, '0') || 's' END"""
ORACLES = {
    "located_report": "SELECT event_type, count(*) FILTER (WHERE value < 10) AS located, count(*) FILTER (WHERE value >= 10) AS unlocated FROM events GROUP BY 1",
    "verdict_tally": "SELECT v AS event_type, count(events.event_type) AS n FROM unnest(['view', 'click', 'purchase', 'error', 'signup', 'refund']) t(v) LEFT JOIN events ON v = events.event_type GROUP BY 1",
    "null_poison_sum": "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value >= 30) > 0 THEN NULL ELSE sum(CASE WHEN event_type = 'error' THEN 0 ELSE round(value * 100)::BIGINT END)::BIGINT END AS spend FROM events GROUP BY 1",
    "timing_stats": f"WITH g AS (SELECT event_type, count(*) AS n, max(value) AS longest, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1) SELECT event_type, n, longest, round(total / n, 6) AS average, n * 60.0::DOUBLE / total AS per_minute, {_TEXT} AS total_text FROM g",
    "agreement_ratio": "SELECT coalesce(avg((quality = 1 - toxic)::INT::DOUBLE), 0) AS agreement, count(*) AS judged FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "recommend_min_by": """
WITH b AS (SELECT p_type, p_brand, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS tokens FROM part GROUP BY 1, 2 HAVING min(p_size) >= 3)
SELECT p_type, first(p_brand ORDER BY tokens, p_brand) AS p_brand, min(tokens) AS tokens FROM b GROUP BY 1""",
    "scale_suggestion": "SELECT l_returnflag, round(sum(l_quantity) / sum(l_linenumber * 7), 6) AS scale, abs(sum(l_quantity) / sum(l_linenumber * 7) - 1) > 0.15 AS suggest FROM lineitem GROUP BY 1",
    "dry_run_plan": "SELECT CASE WHEN p_retailprice >= 1500 THEN 'settled' ELSE 'judge' END AS route, count(*) AS n, sum(p_size)::BIGINT AS tokens, ceil(count(*) / 10)::BIGINT AS calls FROM part GROUP BY 1",
    "first_error": "SELECT user_id, first(props ORDER BY ts, event_id) AS message FROM events WHERE event_type = 'error' GROUP BY 1",
    "table_row_counts": "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS header_rows, count(*) FILTER (WHERE l_linenumber > 1) AS body_rows, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "first_seen_distinct": """
WITH f AS (SELECT user_id, event_type, min(ts) AS t, min(event_id) AS e FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS kinds FROM f GROUP BY 1""",
    "box_union": "SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 5) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY 1",
    "median_threshold": "SELECT l_orderkey, (median(l_quantity) FILTER (WHERE l_returnflag = 'R') + median(l_quantity) FILTER (WHERE l_returnflag <> 'R')) / 2 AS threshold FROM lineitem GROUP BY 1",
    "dominant_by_weight": """
WITH w AS (SELECT c_nationkey, c_mktsegment, sum(round(c_acctbal * 100)::BIGINT) AS w FROM customer GROUP BY 1, 2)
SELECT c_nationkey, first(c_mktsegment ORDER BY w DESC, c_mktsegment) AS segment FROM w GROUP BY 1""",
    "clipped_coverage": "SELECT l_orderkey, sum(greatest(0, least(l_quantity + 6, 40) - greatest(l_quantity, 10))) >= 15 AS across FROM lineitem GROUP BY 1",
    "citation_set": "SELECT p_brand AS citation FROM part UNION SELECT p_type FROM part",
}
