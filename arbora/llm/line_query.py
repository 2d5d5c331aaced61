"""op4: line deduplication of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.line_dedup import dedup_lines
from arbora.sources.tables import table

LEAST_DOCS = 10


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, LEAST_DOCS).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": f"""
WITH whole AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
cut AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM whole),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= {LEAST_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY rid""",
}
