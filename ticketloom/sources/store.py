"""The ticket table: append-only parquet by month, and decisions beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

# Rows of a task where each row is worth some hundred microseconds.
TASK_ROWS = 50_000
_FEW_ROWS = 10_000


def append_tickets(tickets: DataFrame, path: str) -> None:
    """Append tickets under their creation month, so that trend windows read only their months.

    Rows are brought together by month, or each task would write a file per month. AQE splits a
    month that is too large for one task. Within a file rows are in time order, so that a window
    also skips row groups.
    """
    month = F.date_format("created_at", "yyyy-MM")
    (tickets.withColumn("created_month", month).hint("rebalance", "created_month")
     .sortWithinPartitions("created_month", "created_at")
     .write.mode("append").partitionBy("created_month").parquet(path))


def read_tickets(spark: SparkSession, path: str, since: datetime | None = None,
                 until: datetime | None = None) -> DataFrame:
    """Stored tickets, optionally of a time window: other months are not read."""
    tickets = spark.read.parquet(path)
    month, at = F.col("created_month").cast("string"), F.col("created_at")
    if since is not None:
        tickets = tickets.filter((month >= since.strftime("%Y-%m")) & (at >= F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        tickets = tickets.filter((month <= until.strftime("%Y-%m")) & (at <= F.lit(until).cast("timestamp_ntz")))
    return tickets.drop("created_month")


def upload_projection(tickets: DataFrame) -> DataFrame:
    """The four columns of a label-free upload file."""
    return tickets.select(F.col("customer_name").alias("name"), "contact_number", "review", "timestamp")


def balanced(df: DataFrame, keep: bool = False) -> DataFrame:
    """Spread the rows of a file source evenly, over all cores and in tasks of at most some ``TASK_ROWS`` rows.

    Triage is bound by text matching. A split of a file can hold millions of short rows, and a row group is read by one
    split, so the number of splits doesn't tell how the rows lie: they are counted by split, for which parquet reads
    no column. A source that lies well stays as it is read.

    Spark moves filters, and what they compute, below a plain repartition, back to the few tasks of the scan. With ``keep``
    the spread rows are written to the checkpoint folder, so that all work on them is spread.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    rows = sizes.rows or 0
    tasks = max(cores, -(-rows // TASK_ROWS))
    if not rows or sizes.largest * tasks <= 2 * rows:
        return df
    # A few rows are filtered sooner than they are written.
    return stored(df.repartition(tasks), "balanced") if keep and sizes.largest > _FEW_ROWS else df.repartition(tasks)
