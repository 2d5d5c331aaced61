"""Queries of the operators that need Python within a group; tests hold them against direct evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import raster
from arbora.functions.text import marker_kind, normalized_name
from arbora.operators import compare, islands, windows
from arbora.plans.window_queries import document_lines
from arbora.sources.tables import table


def _two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, and the same with every seventh line missing and every fifth changed."""
    left = document_lines(spark, d)
    changed = F.when(F.col("line_no") % 5 == 4, F.concat("line", F.lit(" more"))).otherwise(F.col("line"))
    return left, left.filter("line_no % 7 <> 6").withColumn("line", changed)


def sequence_align_lines(spark: SparkSession, d: str) -> DataFrame:
    return islands.aligned(*_two_sides(spark, d), "doc_id", "line_no", "line")


def dp_anchor_align(spark: SparkSession, d: str) -> DataFrame:
    """Orders' rows aligned with a side that lacks some and differs in others, similar rows first."""
    row = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("string"))
    left = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("at"), row.alias("row"))
    right = left.filter("at % 5 <> 0").withColumn("row", F.when(F.col("at") % 3 == 0, F.concat("row", F.lit(" Note"))).otherwise(F.col("row")))
    return islands.aligned(left, right, "l_orderkey", "at", "row", by_similarity=True)


def describe_difference(spark: SparkSession, d: str) -> DataFrame:
    """Why part names differ from a second edition of them."""
    c = F.col
    second = F.when(c("p_partkey") % 5 == 0, F.initcap("p_name")).when(c("p_partkey") % 5 == 1, F.concat("p_name", F.lit("."))).when(c("p_partkey") % 5 == 2, F.replace("p_name", F.lit(" "), F.lit(" red "))).when(c("p_partkey") % 5 == 3, F.lit("")).otherwise(c("p_name"))
    told = islands.differences(table(spark, d, "part").select("p_partkey", "p_name", second.alias("second")), "p_name", "second")
    return told.select("p_partkey", "difference.kind", "difference.category", "difference.edit_count")


def styled_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(islands.signatures("text").cast("binary")).alias("signature"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    names = part.select("p_partkey", normalized_name(F.col("p_name")).alias("name"))
    folders = part.filter("p_size > 40").select(F.regexp_replace(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.element_at(F.split("p_name", " "), 1)), "[ou]", "0").alias("folder")).distinct()
    return names, folders


def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The folder whose name is most like each part's."""
    return islands.best_matches(*_names(spark, d), "name", "folder")


def fuzzy_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Parts without a close folder."""
    return islands.best_matches(*_names(spark, d), "name", "folder").filter("score < 0.8").select("p_partkey", "score")


def rect_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Figures among an order's strokes."""
    x, y = F.col("l_quantity") * 4, F.col("l_discount") * 900
    boxes = table(spark, d, "lineitem").select("l_orderkey", x.alias("x0"), y.alias("y0"), (x + 25).alias("x1"), (y + 18).alias("y1"))
    return islands.clustered_boxes(boxes, "l_orderkey")


def caption_greedy_claim(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines as images claim the other lines of their order as captions."""
    y = F.col("l_quantity") * 6
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), y.alias("y0"), (y + 10).alias("y1"), F.when(F.col("l_linenumber") % 2 == 0, "Figure").otherwise("Table").alias("kind"), "l_returnflag")
    images, captions = rows.filter("l_returnflag = 'R'").drop("kind", "l_returnflag"), rows.filter("l_returnflag <> 'R'").drop("l_returnflag")
    return islands.claimed_captions(images, captions, "l_orderkey")


def clause_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as markers of a sentence, told apart as clauses and subclauses."""
    tokens = F.array(*map(F.lit, ("a", "i", "ii", "b", "iii", "c", "i", "v", "d", "ii")))
    rows = table(spark, d, "events").select("user_id", "event_id", F.element_at(tokens, (F.col("event_id") % 10 + 1).cast("int")).alias("token"), F.col("value").alias("indent"))
    kinds = rows.withColumn("kind", marker_kind(F.col("token"))).select("user_id", "event_id", "token", "kind", "indent")
    return islands.resolved_clauses(kinds, ["user_id"], "event_id").select("event_id", "token", "resolved")


def table_span_expand(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables whose lines are cells with spans."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("row"), F.col("l_partkey").cast("int").alias("cell"), (F.col("l_quantity") % 3 + 1).cast("int").alias("rowspan"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("colspan"))
    return islands.expanded_tables(rows, "l_orderkey")


def json_typed_walk(spark: SparkSession, d: str) -> DataFrame:
    """Typed objects in JSON made from parts: tables that hold cells, at two depths."""
    made = F.format_string('{"id": %d, "type": "part", "data": [{"type": "table", "id": "t%d", "cells": [{"type": "cell"}, %s]}]}', "p_partkey", "p_size", F.when(F.col("p_size") % 2 == 0, '{"type": "figure", "id": "f"}').otherwise("null"))
    return islands.walked(table(spark, d, "part").select("p_partkey", made.alias("json")), "p_partkey", "json")


def _fake_judge(contents: list[str]) -> list[tuple[int, str]]:
    """Answers by length, leaves out every third and answers every fourth twice."""
    out = []
    for n, content in enumerate(contents, 1):
        if n % 3:
            out.append((n, "same" if len(content) % 2 else "differs"))
        if n % 4 == 0:
            out.append((n, "differs"))
    return out


def judge_loop_fake(spark: SparkSession, d: str) -> DataFrame:
    """Parts packed ten to a batch, judged, checked, asked again once, else an error."""
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("batch"), F.col("p_partkey").alias("row_id"), F.col("p_name").alias("content"))
    return islands.judged(rows, _fake_judge)


def _drawn(vector) -> np.ndarray:
    values = np.asarray(vector, float)[:64].reshape(8, -1)
    canvas = np.full((80, 80, 3), 255, np.uint8)
    canvas[8:72, 8:72] = np.kron(np.where(values > np.median(values), 0, 255), np.ones((8, 64 // values.shape[1])))[:64, :64, None]
    return canvas


def _pair_scores(left: pd.Series, right: pd.Series, label: pd.Series) -> pd.DataFrame:
    """One pair of images is held at a time, however many rows come at once."""

    def scored(a: np.ndarray, b: np.ndarray, formula: bool) -> tuple[float, float, float]:
        return raster.pair_score(a, b, True), raster.ink_correlation(a, b), raster.pair_score(a, b, formula)

    return pd.DataFrame([scored(_drawn(a), _drawn(b), n % 2 == 0) for a, b, n in zip(left, right, label)], columns=["plain", "ink", "score"])


def image_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of images drawn from embeddings against the next one's: hash, ink and what a pair counts as."""
    scores = F.pandas_udf(_pair_scores, "struct<plain: double, ink: double, score: double>")
    rows = table(spark, d, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", scores("embedding", "other", "label").alias("x")).select("vec_id", "x.*")


def admitted_calls(spark: SparkSession, d: str) -> DataFrame:
    """When a limiter of three calls and 150 tokens a minute lets each user's calls in."""
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7.0).alias("at"), F.floor("value").alias("guess"), F.floor(F.col("value") / 2).alias("used"), F.lit(5.0).alias("took"))
    return windows.admitted(rows, ["user_id"], "at", "guess", "used", "took", 3, 150).select("event_id", "starts")


def fuzzy_missing(spark: SparkSession, d: str) -> DataFrame:
    """Folders that no part's name is close to: the reverse of the orphans."""
    names, folders = _names(spark, d)
    return islands.best_matches(folders, names, "folder", "name").filter("score < 0.8").select("folder", "score")


def paired_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders' tables of a customer against a side without each fifth, paired by what their titles say."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("title"))
    return compare.titled_pairs(orders, orders.filter("ord % 5 <> 0"))


QUERIES = {f.__name__: f for f in (image_scores, admitted_calls, fuzzy_missing, paired_tables, sequence_align_lines, dp_anchor_align, describe_difference, styled_signature, fuzzy_best_match, fuzzy_orphans, rect_cluster, caption_greedy_claim, clause_state_machine, table_span_expand, json_typed_walk, judge_loop_fake)}
ORACLES = {
    "json_typed_walk": "SELECT p_partkey, '$' AS path, 'part' AS type, p_partkey::VARCHAR AS id FROM part UNION ALL SELECT p_partkey, '$.data[0]', 'table', 't' || p_size FROM part UNION ALL SELECT p_partkey, '$.data[0].cells[0]', 'cell', NULL FROM part UNION ALL SELECT p_partkey, '$.data[0].cells[1]', 'figure', 'f' FROM part WHERE p_size % 2 = 0",
}
