"""Joins of the reconciliation engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_override(left: DataFrame, overrides: DataFrame, key: str, name: str = "partner_key") -> DataFrame:
    """``left`` with its partner's key: an override where there is one, even a null one, else its own key.

    ``overrides`` is (key, partner); a null partner says "no partner", which a missing row does not."""
    known = overrides.select(F.col("key").alias(key), F.col("partner"), F.lit(True).alias("__known"))
    return left.join(known, key, "left").withColumn(name, F.when(F.col("__known"), F.col("partner")).otherwise(F.col(key))).drop("partner", "__known")


def paired_by_stem(left: DataFrame, right: DataFrame, stem: str) -> DataFrame:
    """Full outer join by stem with status matched, left only or right only."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), stem, "full_outer")
    status = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left only").otherwise("right only")
    return both.withColumn("status", status).drop("__l", "__r")


def longest_prefix(rows: DataFrame, path: str, known: DataFrame, name: str = "owner") -> DataFrame:
    """The longest dotted prefix of ``path``, itself included, that is among ``known`` (owner), and whether it is exact.

    Paths become one row a prefix and meet the known ones in an equi join; no pair of rows is compared."""
    distinct = rows.select(path).distinct()
    parts = F.split(path, r"\.")
    prefixes = distinct.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    best = prefixes.join(known.select(F.col("owner").alias("prefix")).distinct(), "prefix").groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias(name))
    return rows.join(best, path, "left").withColumn("exact", F.col(name).eqNullSafe(F.col(path)))


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, value: str, name: str = "as_of") -> DataFrame:
    """``rows`` with the ``value`` of the latest version of the key at or before ``at``, null where there is none.

    Both sides are laid in one order and the last version is carried forward, so rows are not compared in pairs."""
    one = rows.withColumn("__version", F.lit(0)).withColumn("__value", F.lit(None).cast(dict(versions.dtypes)[value]))
    two = versions.select(*keys, at, F.col(value).alias("__value")).withColumn("__version", F.lit(1))
    laid = one.unionByName(two, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.desc("__version")).rowsBetween(Window.unboundedPreceding, 0)
    carried = laid.withColumn(name, F.last(F.when(F.col("__version") == 1, F.struct("__value")), ignorenulls=True).over(order))
    return carried.filter("__version = 0").withColumn(name, F.col(f"{name}.__value")).drop("__version", "__value")


def without_overlap(rows: DataFrame, others: DataFrame, group: str, condition: Column) -> DataFrame:
    """Rows for which no row of ``others`` in the same group meets a theta condition; ``others`` has prefixed columns."""
    return rows.join(others, (F.col(group) == F.col(f"o_{group}")) & condition, "left_anti")


def unique_key_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key is unique on both sides, joined."""
    alone = lambda side: side.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter("__n = 1").drop("__n")
    return alone(left).join(alone(right), key)


def nth_occurrence(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """The n-th row of a key on the left with the n-th on the right; rows beyond the other side's count keep nulls."""
    ranked = lambda side, order: side.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked(left, left_order).join(ranked(right, right_order), [*keys, "nth"], "left")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` in place of the rows with their keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in a state table: what an exactly-once sink still has to create."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def as_of_or_first(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, value: str, name: str = "as_of") -> DataFrame:
    """``as_of``, and the key's first version where none is early enough; null only where a key has no version."""
    first = versions.groupBy(*keys).agg(F.min_by(value, F.struct(at, value)).alias("__first"))
    return as_of(rows, versions, keys, at, value, name).join(first, keys, "left").withColumn(name, F.coalesce(name, "__first")).drop("__first")


def deepest_owner(rows: DataFrame, levels: list[DataFrame], keys: list[str], at: str, name: str = "owner") -> DataFrame:
    """``rows`` with the deepest node that stands at or before them: on each level the latest child of the node found above.

    A level is (keys, at, node, parent), the first one's parent null; a node without such a child owns the row itself."""
    found = rows.withColumn(name, F.lit(None).cast("string")).withColumn("__up", F.lit("").cast("string"))
    for level in levels:
        nodes = level.select(*keys, F.col(at), F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("__up"), F.col("node").cast("string").alias("node"))
        found = as_of(found, nodes, [*keys, "__up"], at, "node", "__node")
        found = found.withColumn(name, F.coalesce("__node", name)).withColumn("__up", F.coalesce("__node", F.lit("\u0001"))).drop("__node")
    return found.drop("__up")


def required(rows: DataFrame, table: DataFrame, key: str, what: str) -> DataFrame:
    """``rows`` joined with ``table`` by key; a row without a partner is an error that names its key."""
    met = rows.join(table.withColumn("__met", F.lit(True)), key, "left")
    checked = F.when(F.col("__met"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {what} "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))
    return met.withColumn(key, checked).drop("__met")
