"""Snapshots of a ticket table: parquet in buckets by ticket id, so that logs by id join without moving tickets.

A snapshot is an external table of the session's catalog over its folder, since only catalog tables have buckets. The
definition is made again wherever the folder is read; its name is a digest of the folder.

A look-up by ``id`` reads one bucket, in which rows are in order of id; one by ``ticket_id`` asks the Bloom filters in
the footers of the files.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "version int, below bigint, buckets int"


class Snapshot(NamedTuple):
    """``version`` counts from 1; every ticket of it has an id less than ``below``."""
    version: int
    below: int
    buckets: int


NONE = Snapshot(0, 1, 0)


def _defined(spark: SparkSession, root: str, at: Snapshot, columns: str) -> str:
    """The name of the table over the folder of ``at``, defined in this session's catalog."""
    folder = f"{root}/compacted/v{at.version}"
    name = f"tickets_{hashlib.md5(folder.encode()).hexdigest()}_{at.buckets}"
    location = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"OPTIONS ('parquet.bloom.filter.enabled#ticket_id' = 'true') "
              f"CLUSTERED BY (id) SORTED BY (id) INTO {at.buckets} BUCKETS LOCATION '{location}'")
    return name


def read(spark: SparkSession, root: str, at: Snapshot, columns: str) -> DataFrame:
    return spark.table(_defined(spark, root, at, columns))


def write(tickets: DataFrame, root: str, at: Snapshot, columns: str) -> None:
    """Replace what an earlier try left in the folder of ``at``. Each bucket is one file."""
    name = _defined(tickets.sparkSession, root, at, columns)
    target = tickets.sparkSession.table(name).columns
    tickets.select(*target).repartition(at.buckets, "id").sortWithinPartitions("id").write.insertInto(name, overwrite=True)
