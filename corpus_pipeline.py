"""A corpus pipeline of the training-data operators: each stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import row_keys, staged
from arbora.llm.decontamination import decontaminated
from arbora.llm.line_dedup import dedup_lines
from arbora.llm.mixing import mix
from arbora.llm.quality import KEPT, fit, judged
from arbora.llm.simhash import near_groups
from arbora.llm.simhash_query import LINK_BITS
from arbora.sources.tables import table

LEAST_DOCS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged by their zero measures and their source."""
    kept = judged(docs, fit(docs, table(spark, sf_dir, "labels"))).filter(F.col("quality_score") >= KEPT)
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from every document; n_chars follows the text. A null text comes back empty."""
    return dedup_lines(docs, LEAST_DOCS).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the least id: texts are linked by op8's fingerprints, and by the set join beyond their
    reach. Rows without an id stay, as no id can tell them apart."""
    row = ["__k1", "__k2"]
    keyed = docs.withColumns(dict(zip(row, row_keys(*docs.columns))))
    groups = staged(near_groups(keyed, carried=tuple(row), bits=LINK_BITS))
    kept = groups.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", *row)).alias("x")).select("x.__k1", "x.__k2")
    repeated = not groups.filter("doc_id IS NOT NULL").groupBy(*row).count().filter("count > 1").isEmpty()
    stay = keyed.join(kept.hint("merge"), row, "left_semi")  # as many as documents, so never broadcast
    if repeated:
        stay = stay.dropDuplicates(row)  # rows that are equal in every column
    return stay.unionByName(keyed.filter("doc_id IS NULL")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, nothing of null and empty texts; a null source is a source."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixing),
]

#: A trained model and sampled hashes stand behind stages, so SQL can't give the rows; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
