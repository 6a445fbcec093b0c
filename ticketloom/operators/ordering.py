"""Dense row numbers and running totals over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

_POSITION_BITS = 33


def _range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted, with partition ``_part`` and place ``_place`` stored.

    The two columns are written out with the rows. Later jobs read the same values, whatever
    happens to an executor in between; recomputing a range partitioning could move its bounds.
    """
    place = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", place)
    kept = stored(sorted_rows, "ordered")
    return kept.withColumns({
        "_part": F.shiftright("_mark", _POSITION_BITS),
        "_place": F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
    }).drop("_mark")


def _offsets(per_part: DataFrame) -> DataFrame:
    """Sum of ``_size`` over all earlier partitions. One row per partition, so one task is fine."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_number") -> DataFrame:
    """Add dense 1-based row numbers in ``order``, which must be unique per row."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _range_sorted(df, order)
    offsets = _offsets(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")))
    # One row per partition, at most spark.sql.shuffle.partitions rows.
    return (rows.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_place") + 1)
            .drop("_part", "_place", "_offset"))


def with_first(df: DataFrame, order: list[Column], count: int, name: str) -> DataFrame:
    """Add whether a row is among the first ``count`` in ``order``, which must be unique per row.

    The sizes of the range partitions, one number each, show in which of them the count runs out.
    """
    rows = _range_sorted(df, order)
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, last = count, -1
    for last in sorted(sizes):
        if left <= sizes[last]:
            break
        left -= sizes[last]
    among = (F.col("_part") < last) | ((F.col("_part") == last) & (F.col("_place") < left))
    return rows.withColumn(name, among).drop("_part", "_place")


def running_total(df: DataFrame, key: str, weight: str, name: str) -> DataFrame:
    """Add the inclusive running sum of ``weight`` in order of the unique ``key``."""
    rows = _range_sorted(df, [F.col(key)])
    offsets = _offsets(rows.groupBy("_part").agg(F.sum(weight).alias("_size")))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_inner", F.sum(weight).over(within)).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_inner"))
            .drop("_part", "_place", "_inner", "_offset"))


def with_previous(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the value of the unique ``key`` that comes before a row's own, null for the first row."""
    rows = _range_sorted(df, [F.col(key)])
    ends = rows.groupBy("_part").agg(F.max(key).alias("_last"))
    earlier = ends.select("_part", F.max("_last").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.lag(key).over(Window.partitionBy("_part").orderBy(key))
    # One row per partition, at most spark.sql.shuffle.partitions rows.
    return (rows.withColumn(name, inside).join(F.broadcast(earlier), "_part")
            .withColumn(name, F.coalesce(name, "_carried")).drop("_part", "_place", "_carried"))


def number_file_rows(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Add dense 1-based row numbers in file order to rows straight from a file source.

    A file split is read by one task from start to end, so a row's place in its split is its mark
    minus the split's first mark. Only one small row per split is aggregated; the rows themselves
    are not shuffled. Call before any filter: skipped rows still count.
    """
    split = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    rows = df.withColumns({**split, "_mark": F.monotonically_increasing_id()})
    sizes = rows.groupBy("_file", "_start").agg(
        F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    offsets = offsets.drop("_size")
    # One small row per file split of about 128 MB: under a million rows for 100 TB.
    return (rows.join(F.broadcast(offsets), ["_file", "_start"])
            .withColumn(name, F.col("_offset") + F.col("_mark") - F.col("_first") + 1)
            .drop("_file", "_start", "_mark", "_first", "_offset"))
