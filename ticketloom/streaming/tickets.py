"""Tickets as an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..operators.ingest import clean_reviews
from ..operators.triage import triage

_VERSIONS = 4

# Tasks per core that a micro-batch is spread over: how many rows it has is not known before it is read.
_SPREAD = 4


def read_ticket_files(spark: SparkSession, folder: str, schema, pattern: str | None = None,
                      files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files that arrive in a folder.

    A file of one row group is read by one task, so each micro-batch is spread over all cores.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).repartition(_SPREAD * spark.sparkContext.defaultParallelism)


def triage_stream(tickets: DataFrame, sink: str, checkpoint: str,
                  threshold: float = fixed.CONFIDENCE_THRESHOLD) -> StreamingQuery:
    """Clean, triage and append each ticket exactly once. Stateless, so no watermark is needed.

    Handles everything available, then stops; start it again for what has arrived since.
    """
    return (triage(clean_reviews(tickets), threshold).writeStream.format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def live_counts(tickets: DataFrame) -> DataFrame:
    """Running counts by status and final labels: at most a few hundred groups of state."""
    return tickets.groupBy("routing_status", "final_category", "final_priority", "final_department").agg(
        F.count(F.lit(1)).alias("tickets"))


def live_kpi_stream(tickets: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the current counts in a parquet folder: complete versions of the last few batches.

    Batches take turns in ``_VERSIONS`` folders, so a batch that is retried replaces itself, a reader
    of the version before is not disturbed, and history doesn't grow.
    """
    def save(counts: DataFrame, batch: int) -> None:
        counts.withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(
            f"{sink}/slot={batch % _VERSIONS}")

    return (live_counts(tickets).writeStream.foreachBatch(save)
            .option("checkpointLocation", checkpoint).outputMode("complete")
            .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The newest complete version of the live counts."""
    versions = spark.read.parquet(sink)
    newest = versions.agg(F.max("batch").alias("batch"))
    return versions.join(F.broadcast(newest), "batch").drop("batch", "slot")


def kpis_from_counts(counts: DataFrame) -> DataFrame:
    """Status KPIs from live counts, as the batch report gives them for unreviewed tickets."""
    def tally(status: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("routing_status") == status, F.col("tickets"))), F.lit(0))

    return counts.agg(
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets"),
        tally("AUTO_ROUTED").alias("auto_routed_count"),
        tally("HUMAN_REVIEW").alias("human_review_count"),
        tally("RESOLVED").alias("resolved_review_count"))
