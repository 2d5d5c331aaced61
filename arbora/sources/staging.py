"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame

from arbora.sources.shipping import ship


@cache
def _own_dir() -> str:
    """A folder of this process, gone when it ends; only for sessions that name no shared one, as in tests."""
    path = tempfile.mkdtemp(prefix="arbora-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where none is set and one machine runs everything."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_dir()


def _folder(df: DataFrame) -> str:
    """Where this application stages: one folder, so that all of it can go at once."""
    return f"{shared_dir(df).rstrip('/')}/staged-{df.sparkSession.sparkContext.applicationId}"


def unstage(df: DataFrame) -> None:
    """Remove all that this application has staged; results that were not written yet can't be read any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_folder(df))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let go of shuffles, broadcasts and plans that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a heap that may still grow puts off; runs of many small jobs grow it."""
    df.sparkSession.sparkContext._jvm.System.gc()


def staged(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared folder and read it back: a compressed, columnar checkpoint."""
    ship(df.sparkSession)
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
