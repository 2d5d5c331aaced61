"""op3: verdicts on the urls of ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.url_filter import Rule, judge
from arbora.sources.tables import table

RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def _document() -> Column:
    """The path of a page ends in the id of its document, so a label of that document is one of the page."""
    return F.nullif(F.regexp_extract("url", r"^[^?#]*/([0-9]{1,18})(?:[/.?#]|$)", 1), F.lit("")).try_cast("bigint")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), RULES, _document())


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES: dict[str, str] = {}
