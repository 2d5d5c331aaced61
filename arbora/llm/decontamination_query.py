"""op7: ``benchmark`` passages in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.decontamination import SPAN, hits
from arbora.sources.tables import table


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), SPAN)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {
    "op7_decontamination": f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
item_starts AS (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {SPAN} + 1))) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(w[i:i + {SPAN} - 1], ' ') AS win, least(len(w), {SPAN}) AS n FROM item_starts),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
doc_starts AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
found AS (SELECT d.rid, d.i, d.n, wins.item FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM doc_starts) d JOIN wins ON d.win = wins.win AND d.n = wins.n),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)""",
}
