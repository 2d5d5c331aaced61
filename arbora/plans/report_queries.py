"""Reports, cards, descriptions and viewer joins on the driver's tables."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from arbora.functions import records
from arbora.operators.compare import nearest_shown
from arbora.sources.tables import table

c = F.col
FORMULA_MATCH = 0.7


def _string(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Rich-text descriptions of parts: a story, criteria in a list, and a section that some lack."""
    section = lambda h, t, xs, o: F.struct(F.lit(h).alias("heading"), t.alias("text"), xs.alias("items"), F.lit(o).alias("ordered"))
    none = F.array().cast("array<string>")
    parts = F.array(section("User story", _string("As **", c("p_brand"), "** I use `x`"), none, False), section("Criteria", F.lit(""), F.array(c("p_name"), F.lit("`done`")), True))
    sections = F.when(c("p_size") % 3 == 0, F.filter(parts, lambda s: s["heading"] == "none")).when(c("p_size") % 3 == 1, F.slice(parts, 1, 1)).otherwise(parts)
    return table(spark, d, "part").select("p_partkey", records.rich_document(sections).alias("description"))


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an HTML report on parts, in the class of their verdict."""
    verdict = F.element_at(F.array(*map(F.lit, ("IDENTICAL", "DIFFERENT", "SKIPPED", "OTHER"))), (c("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", records.html_row([_string("<", c("p_name"), ">"), verdict, F.when(c("p_size") > 9, c("p_size"))], records.verdict_class(verdict)).alias("row"))


def summary_cards(spark: SparkSession, d: str) -> DataFrame:
    """The cards of a report over all lines: rows, tokens, cost and rate, unknown as soon as one part is."""
    lines = table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("tokens"), F.count_if(c("l_returnflag") == "A").alias("settled"), F.count_if(c("l_tax").isNull()).alias("unknown"))
    cost = F.when(c("unknown") == 0, c("tokens") * 2.5 / 1e6)
    cards = F.array(records.card("images", records.whole_number(c("n"))), records.card("settled by hash", records.whole_number(c("settled"))), records.card("total tokens", records.whole_number(c("tokens"))), records.card("cost this run", records.money(cost)), records.card("pairs per minute", records.rate(F.lit(None).cast("double"))))
    return lines.select(F.explode(cards).alias("x")).select("x.label", "x.value")


def verdict_options(spark: SparkSession, d: str) -> DataFrame:
    """The choices of a verdict filter: all, then each with its count."""
    each = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(c("event_type").alias("value"), _string(c("event_type"), " (", c("n"), ")").alias("label"))
    return spark.createDataFrame([("ALL", "All verdicts")], "value string, label string").unionByName(each)


def pair_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of judged, cached and failed orders."""
    error = F.when(c("o_orderstatus") == "P", F.lit("no answer"))
    record = records.pair_record(_string(c("o_orderkey")), c("o_orderpriority"), c("o_totalprice"), c("o_custkey") % 3 == 0, error, c("o_custkey") / 4)
    return table(spark, d, "orders").select(record.alias("r")).select("r.*")


def variant_costs(spark: SparkSession, d: str) -> DataFrame:
    """Each variant of a calibration (edge, batch) over the same sample of parts: calls and tokens."""
    variants = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(b).alias("batch")) for e in (256, 512) for b in (1, 6)))
    tokens = F.ceil(F.least(c("p_size") * 40, c("v.edge")) / 32)
    runs = table(spark, d, "part").select("p_partkey", "p_size", F.explode(variants).alias("v"))
    return runs.groupBy("v.edge", "v.batch").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.first("v.batch")).alias("calls"), F.sum(tokens).cast("long").alias("tokens"))


def stamped_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Regions with the stamp of the snapshot that they were read for."""
    return table(spark, d, "region").select("r_regionkey", F.lit("2024-01-10").alias("as_of"), F.lit(1).alias("version"))


def viewed_images(spark: SparkSession, d: str) -> DataFrame:
    """Customers' images of ticked classes, each at the nearest shown node of the region tree."""
    nation = table(spark, d, "nation")
    places = table(spark, d, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).select(_string(c("n_regionkey"), "/", c("n_nationkey"), "/", c("c_custkey")).alias("path"), "c_custkey", "c_mktsegment")
    upper = nation.select(_string(c("n_regionkey")).alias("path")).unionByName(nation.select(_string(c("n_regionkey"), "/", c("n_nationkey")).alias("path"))).distinct()
    shown = (F.size(F.split("path", "/")) < 3) & (F.length("path") % 2 == 1)
    hosts = nearest_shown(places.select("path").unionByName(upper), shown, 3)
    ticked = places.filter(c("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return ticked.join(hosts, "path").groupBy("host").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype=float)


def formula_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether formulas read from images say what the site shows: letters and digits in order; an empty side never does."""
    read = F.when(c("p_size") % 4 == 0, "").when(c("p_size") % 4 == 1, _string("X_1 = ", c("p_partkey"))).when(c("p_size") % 4 == 2, F.lit("zzzz")).otherwise(_string("x1", c("p_partkey"), "!"))
    site = _string("x1 = ", c("p_partkey"))
    return table(spark, d, "part").select("p_partkey", (_ratio(records.formula_letters(read), records.formula_letters(site)) >= FORMULA_MATCH).alias("matches"))


QUERIES = {f.__name__: f for f in (descriptions, report_rows, summary_cards, verdict_options, pair_records, variant_costs, stamped_snapshot, viewed_images, formula_matches)}

ORACLES = {
    "descriptions": """
WITH s AS (SELECT p_partkey, p_size, '{"type":"heading","attrs":{"level":3},"content":[{"type":"text","text":"User story"}]},{"type":"paragraph","content":[{"type":"text","text":"As "},{"type":"text","text":"' || p_brand || '","marks":[{"type":"strong"}]},{"type":"text","text":" I use "},{"type":"text","text":"x","marks":[{"type":"code"}]}]}' AS a,
'{"type":"heading","attrs":{"level":3},"content":[{"type":"text","text":"Criteria"}]},{"type":"orderedList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"' || p_name || '"}]}]},{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"done","marks":[{"type":"code"}]}]}]}]}' AS b FROM part)
SELECT p_partkey, '{"type":"doc","version":1,"content":[' || CASE p_size % 3 WHEN 0 THEN '{"type":"paragraph","content":[]}' WHEN 1 THEN a ELSE a || ',' || b END || ']}' AS description FROM s""",
    "report_rows": "SELECT p_partkey, '<tr class=\"' || ['verdict-ok', 'verdict-bad', 'verdict-warn', 'verdict-none'][p_size % 4 + 1] || '\"><td>&lt;' || p_name || '&gt;</td><td>' || ['IDENTICAL', 'DIFFERENT', 'SKIPPED', 'OTHER'][p_size % 4 + 1] || '</td><td>' || CASE WHEN p_size > 9 THEN p_size::VARCHAR ELSE '' END || '</td></tr>' AS row FROM part",
    "summary_cards": """
WITH a AS (SELECT count(*) AS n, sum(l_quantity)::BIGINT AS t, count(*) FILTER (WHERE l_returnflag = 'A') AS s FROM lineitem)
SELECT 'images' AS label, format('{:,}', n) AS value FROM a UNION ALL SELECT 'settled by hash', format('{:,}', s) FROM a UNION ALL SELECT 'total tokens', format('{:,}', t) FROM a UNION ALL SELECT 'cost this run', printf('$%.5f', t * 2.5 / 1e6) FROM a UNION ALL SELECT 'pairs per minute', '—'""",
    "verdict_options": "SELECT 'ALL' AS value, 'All verdicts' AS label UNION ALL SELECT event_type, event_type || ' (' || count(*) || ')' FROM events GROUP BY event_type",
    "pair_records": """
SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus = 'P' THEN 'ERROR' ELSE o_orderpriority END AS verdict, o_totalprice AS score, o_custkey % 3 = 0 AND o_orderstatus <> 'P' AS cached, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 <> 0 THEN o_custkey / 4 END AS cost_now, CASE WHEN o_orderstatus <> 'P' THEN o_custkey / 4 END AS cost, CASE WHEN o_orderstatus = 'P' THEN 'no answer' END AS error FROM orders""",
    "variant_costs": "SELECT edge, batch, count(*) AS n, ceil(count(*) / batch)::BIGINT AS calls, sum(ceil(least(p_size * 40, edge) / 32))::BIGINT AS tokens FROM part, (SELECT unnest([256, 512]) AS edge), (SELECT unnest([1, 6]) AS batch) GROUP BY 1, 2",
    "stamped_snapshot": "SELECT r_regionkey, '2024-01-10' AS as_of, 1 AS version FROM region",
    "viewed_images": """
WITH n AS (SELECT n_nationkey, CASE WHEN length(n_regionkey || '/' || n_nationkey) % 2 = 1 THEN n_regionkey || '/' || n_nationkey ELSE n_regionkey::VARCHAR END AS host FROM nation)
SELECT host, count(*) AS n, min(c_custkey) AS first FROM customer JOIN n ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
    "formula_matches": "SELECT p_partkey, p_size % 4 IN (1, 3) AS matches FROM part",
}
