"""Files in and out: checked JSON, visible files, bytes beside rows, configuration, caches and states, merged manifests.

Everything goes through Spark's readers and Hadoop's file systems, so a path may lie in any store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PageSource(Protocol):
    """What the structure operators ask of a source of positioned pages; any object that has these tables will do."""

    def spans(self) -> DataFrame: ...

    def rectangles(self) -> DataFrame: ...

    def images(self) -> DataFrame: ...


def first_that_works(*loads: Callable[[], DataFrame]) -> DataFrame:
    """The first source that answers; where none does, an error that tells each one's."""
    told = []
    for load in loads:
        try:
            found = load()
            found.schema  # noqa: B018 - a source that can't be read fails here
            return found
        except Exception as e:  # noqa: BLE001 - any failure of one source passes on to the next
            told.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    raise ValueError("no source works: " + "; ".join(told))


def checked_json(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON of a schema; a missing file, a broken document or a null in a required field is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    return rows


def visible_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, stem, length) of the files of a folder; names that begin with a dot or an underscore are hidden. Contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select(name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def with_bytes(rows: DataFrame, column: str, folder: str, name: str = "content") -> DataFrame:
    """``rows`` with the bytes of the file that ``column`` names relative to ``folder``; null where there is none."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return rows.join(files.select(relative.alias(column), F.col("content").alias(name)), column, "left")


def settings(text: Column) -> Column:
    """The names and values of a dotenv text as a map; comments and lines without a sign are passed over, the last value of a name counts."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^export\s+", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit("=")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.instr(x, "=") + 1, F.length(x))), r"""^["']+|["']+$""", "").alias("v"))
    pairs = F.transform(kept, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a written folder in the place of another; a reader finds the old or the new one, or for an instant none."""
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    if system.exists(target):
        system.rename(target, old)
    system.rename(fresh, target)
    system.delete(old, True)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache of JSON lines; a missing one is empty, and so is one with a line that is none of its own."""
    empty = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, __broken string").option("columnNameOfCorruptRecord", "__broken").json(path).cache()
    except Exception as e:  # noqa: BLE001 - only a path that is not there is no cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    try:
        return empty if not rows.filter("__broken IS NOT NULL").isEmpty() else spark.read.schema(schema).json(path)
    finally:
        rows.unpersist()


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_cache(rows: DataFrame, path: str) -> None:
    """Replace a cache as a whole; unset fields are left out of its lines."""
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", True).json(new)
    _replace(rows.sparkSession, new, path)


def pruned(rows: DataFrame, kind: str, kept: dict[str, tuple[str, ...]], columns: tuple[str, ...]) -> DataFrame:
    """``columns`` emptied for types that do not keep them, so that an index leaves them out."""
    for name in columns:
        types = [t for t, names in kept.items() if name in names]
        rows = rows.withColumn(name, F.when(F.col(kind).isin(types) & (F.col(name).cast("string") != ""), F.col(name)))
    return rows


def to_publish(parents: DataFrame, children: DataFrame, created: DataFrame) -> DataFrame:
    """(key, parent, parent_id, step) still to be made: parents first, children with their parent's id where it is known already.

    ``created`` is the state (key, id); what it has is never made again."""
    known = created.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"))
    left = parents.select("key", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("step")).unionByName(children.select("key", "parent", F.lit(1).alias("step")))
    return left.join(created.select("key"), "key", "left_anti").join(known, "parent", "left").select("key", "parent", "parent_id", "step")


def report_lines(pairs: DataFrame) -> DataFrame:
    """(ord, line) of a text report over (stem, left, right, score): matched files by rising score, then those of one side alone."""
    both, alone = F.col("left").isNotNull() & F.col("right").isNotNull(), F.coalesce("left", "right")
    line = F.when(both, F.concat(F.col("stem"), F.lit(": "), F.format_string("%.1f%%", "score"))).when(F.col("left").isNotNull(), F.concat(F.lit("only left: "), alone)).otherwise(F.concat(F.lit("only right: "), alone))
    rank = F.when(both, 0).when(F.col("left").isNotNull(), 1).otherwise(2)
    return pairs.select(F.struct(rank.alias("part"), F.when(both, F.col("score")).alias("score"), "stem").alias("ord"), line.alias("line"))
