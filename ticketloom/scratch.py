"""Where intermediate results live: the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}

# Folders of the tables stored since the innermost ``passing`` began.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)

# Shuffle files of a write go when it ends; else they stay until the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session may go without: it gets a temporary folder. On a cluster a folder that
    one machine sees would lose data with that machine, so the setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = context.applicationId
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="ticketloom-")
    return _LOCAL_FOLDERS[key]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: short lineage that survives the loss of an executor."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    table._stored_in = folder
    if (passing_folders := _PASSING.get()) is not None:
        passing_folders.append(folder)
    return table


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables stored inside when it ends, but those given to the function it yields. These belong to the
    ``passing`` around it, if there is one. What is built on a deleted table can't be read any more, so results are stored."""
    outer, own, kept = _PASSING.get(), [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._stored_in)
        return table

    token = _PASSING.set(own)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _PASSING.reset(token)
        if outer is not None:
            outer.extend(kept)
        for folder in own:
            if folder not in kept:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
