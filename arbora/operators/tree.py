"""Hierarchical keys over a tree given level by level, and bottom-up roll-up.

A level is a DataFrame of node_id, parent_id, type, identifier and ord. Levels are joined to the one above by parent, so each
key is built from its parent's with one join a level and no recursion over rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.text import dotted, normalized_identifier
from arbora.sources.staging import staged

RESTARTS = ("fixed", "root")


@dataclass(frozen=True)
class KeyRule:
    """How a type's key is built: fixed, root, absolute, child, suffix, literal or ordinal; ``fallback`` for empty identifiers."""

    kind: str
    prefix: str = ""
    scoped: bool = False
    fallback: str = ""
    scope: bool = False


def group_rank(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the rank from 1 of each row within its key, where a key may hold a large share of all rows.

    Rows are dealt by ranges of key and order; ranks within a range are shifted by the key's rows in the ranges before."""
    dealt = staged(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    counts = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    renamed = before.select(F.col("__part").alias("__p"), "__before", *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__p"))
    return dealt.withColumn("__within", within).join(renamed, same).withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__p", "__within", "__before", *(f"__k{i}" for i in range(len(keys))))


def _by_rule(types: dict[str, KeyRule], value) -> Column:
    out = F.lit(None)
    for name, rule in types.items():
        out = F.when(F.col("type") == name, value(rule)).otherwise(out)
    return out


def keyed_level(level: DataFrame, above: DataFrame | None, rules: dict[str, KeyRule]) -> DataFrame:
    """``level`` with key, root_key, scope_key and path (its place in a walk of the tree)."""
    place = F.lpad(F.col("ord").cast("string"), 12, "0")
    if above is None:
        context = level.select("*", F.lit("").alias("parent_key"), F.lit("").alias("up_root"), F.lit("").alias("up_scope"), place.alias("path"))
    else:
        up = above.select(F.col("node_id").alias("parent_id"), F.col("key").alias("parent_key"), F.col("root_key").alias("up_root"), F.col("scope_key").alias("up_scope"), F.col("path").alias("up_path"))
        context = level.join(up, "parent_id").withColumn("path", F.concat("up_path", F.lit("/"), place)).drop("up_path")
    ident = F.coalesce(normalized_identifier(F.col("identifier")), F.lit(""))
    needs = _by_rule(rules, lambda r: F.lit(r.kind in ("root", "absolute", "child", "suffix")))
    kind = _by_rule(rules, lambda r: F.lit(r.kind))
    kind = F.when(F.coalesce(needs, F.lit(False)) & (ident == ""), F.when(F.coalesce(_by_rule(rules, lambda r: F.lit(r.fallback)), F.lit("")) != "", "fixed").otherwise("ordinal")).otherwise(F.coalesce(kind, F.lit("ordinal")))
    context = context.withColumn("__kind", kind).withColumn("__prefix", F.when((F.col("__kind") == "fixed") & needs, _by_rule(rules, lambda r: F.lit(r.fallback))).when((F.col("__kind") == "ordinal") & F.coalesce(needs, F.lit(True)), F.col("type")).otherwise(_by_rule(rules, lambda r: F.lit(r.prefix))))
    context = context.withColumn("__base", F.when(F.coalesce(_by_rule(rules, lambda r: F.lit(r.scoped)), F.lit(False)), F.col("up_scope")).otherwise(F.col("parent_key")))
    # a parent may hold a large share of the level, so its ordinals are ranks over ranges
    context = group_rank(context, ["__base", "type", "__kind"], ["path"], "__nth")
    plain = (
        F.when(F.col("__kind") == "fixed", F.col("__prefix"))
        .when(F.col("__kind") == "root", F.concat("__prefix", ident))
        .when(F.col("__kind") == "absolute", dotted(F.col("up_root"), ident))
        .when(F.col("__kind") == "child", dotted(F.col("parent_key"), ident))
        .when(F.col("__kind") == "suffix", F.concat("parent_key", ident))
        .when(F.col("__kind") == "literal", dotted(F.col("parent_key"), F.col("__prefix")))
        .otherwise(dotted(F.col("__base"), F.concat("__prefix", F.col("__nth").cast("string"))))
    )
    built = context.withColumn("__plain", plain)
    restarts = F.col("__kind").isin(*RESTARTS)  # may share one key in any number, so each is a group of its own here
    again = F.row_number().over(Window.partitionBy("__plain", F.when(restarts, F.col("path"))).orderBy("path"))
    built = built.withColumn("key", F.when(restarts, F.col("__plain")).when(again == 1, F.col("__plain")).otherwise(F.concat("__plain", F.lit("~"), again.cast("string"))))
    scopes = F.coalesce(_by_rule(rules, lambda r: F.lit(r.scope)), F.lit(False))
    built = built.withColumn("root_key", F.when(restarts, F.col("key")).otherwise(F.col("up_root"))).withColumn("scope_key", F.when(restarts | scopes, F.col("key")).otherwise(F.col("up_scope")))
    return built.drop("__kind", "__prefix", "__base", "__plain", "__nth", "up_root", "up_scope")


def keyed_levels(levels: list[DataFrame], rules: dict[str, KeyRule]) -> list[DataFrame]:
    """Each level with its keys, from the top; a level is written once, as the one below and its readers ask for it again."""
    out: list[DataFrame] = []
    for level in levels:
        out.append(staged(keyed_level(level, out[-1] if out else None, rules)))
    return out


def rolled_up(leaves: DataFrame, ancestors: list[str], ok: str = "ok") -> DataFrame:
    """(key, depth, ok, n_failed): every leaf and each of its ancestors, true where all leaves below are.

    Leaves carry their ancestors' keys as columns; sums are combined before they are shuffled, so a root costs no more."""
    closure = F.explode(F.array(*(F.struct(F.col(c).alias("key"), F.lit(i).alias("depth")) for i, c in enumerate(ancestors))))
    return leaves.select(closure.alias("x"), ok).groupBy("x.key", "x.depth").agg(F.bool_and(ok).alias("ok"), F.count_if(~F.col(ok)).alias("n_failed"))
