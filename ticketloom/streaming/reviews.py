"""Live counts that follow reviews: uploads, decisions and deletions in, counts of the present state out.

Each micro-batch keeps one row for each ticket it has events of, beside the checkpoint: the ticket's uploaded group, its
latest decision, whether it was deleted. A ticket's state is the fold of its rows, so a batch reads the rows of the
batches before it for its own tickets only (a scan of narrow rows, a join by id) and compares the state before
with the state after. An event that moves a ticket to another group gives two changes, one withdrawn and one added. The
changes of a micro-batch are summed and added to the counts of the batch before, so a version of the counts is a few
hundred rows however many tickets there are. All of it is built-in columns; no ticket is handled in Python.

Events may come in any order and any number of times: a decision or deletion may be earlier than its ticket, and the
first upload of an id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics
from ..scratch import stored
from .tickets import _VERSIONS, latest_counts

GROUP = ["routing_status", "final_category", "final_priority", "final_department", "is_reviewed"]
_GROUP_SCHEMA = "routing_status string, final_category string, final_priority string, final_department string, is_reviewed boolean"
_UPLOAD, _DECISION, _DELETION = "upload", "decision", "deletion"
# What a batch keeps of a ticket; decisions compare by time, then content, and a missing value comes first.
_DECIDED = "at string, kind string, category string, priority string, department string"
_KEPT = f"id bigint, uploaded struct<{_GROUP_SCHEMA}>, decision struct<{_DECIDED}>, deleted boolean, batch bigint"


def review_events(uploads: DataFrame, decisions: DataFrame, deletions: DataFrame) -> DataFrame:
    """One stream (or table) of events from uploaded tickets, decisions in ``review.DECISION_SCHEMA``, and deleted ids.
    Rows without an id, and decisions without a time, mean nothing."""
    def event(rows: DataFrame, kind: str, status: Column, labels: list[Column], reviewed: Column, at: Column, decision: Column) -> DataFrame:
        return rows.filter(F.col("id").isNotNull()).select(
            F.col("id").cast("bigint").alias("id"), F.lit(kind).alias("event"), status.cast("string").alias("routing_status"),
            *[c.cast("string").alias(n) for c, n in zip(labels, ("category", "priority", "department"))],
            reviewed.cast("boolean").alias("is_reviewed"), at.cast("string").alias("decided_at"), decision.cast("string").alias("kind"))

    none = F.lit(None)
    # Times as text of fixed width, which sorts as the times do.
    at = F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return (event(uploads, _UPLOAD, F.col("routing_status"), [F.col(f"final_{n}") for n in ("category", "priority", "department")],
                  F.col("is_reviewed"), none, none)
            .unionByName(event(decisions.filter(F.col("decided_at").isNotNull()), _DECISION, none,
                               [F.col(f"decided_{n}") for n in ("category", "priority", "department")], none, at, F.col("kind")))
            .unionByName(event(deletions, _DELETION, none, [none] * 3, none, none, none)))


def _by_ticket(events: DataFrame, batch: int) -> DataFrame:
    """One row for each ticket of a batch's events, in the layout of ``_KEPT``."""
    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("event") == kind, value)

    labels = ["category", "priority", "department"]
    uploaded = F.struct("routing_status", *[F.col(n).alias(f"final_{n}") for n in labels], "is_reviewed")
    decision = F.struct(F.col("decided_at").alias("at"), "kind", *labels)
    return events.groupBy("id").agg(
        F.min(of(_UPLOAD, uploaded)).alias("uploaded"), F.max(of(_DECISION, decision)).alias("decision"),
        F.max(F.col("event") == _DELETION).alias("deleted"), F.lit(batch).cast("bigint").alias("batch"))


def _present_group(uploaded: Column, decision: Column, deleted: Column) -> Column:
    """The group a ticket counts in now; null before its upload and after its deletion."""
    resolved = F.struct(F.lit("RESOLVED").alias(GROUP[0]), *[decision[n].alias(f"final_{n}") for n in ("category", "priority", "department")],
                        F.lit(True).alias(GROUP[4]))
    return F.when(uploaded.isNull() | deleted, None).when(decision.isNotNull(), resolved).otherwise(uploaded)


def group_changes(kept: DataFrame, known: DataFrame, batch: int) -> DataFrame:
    """(group, tickets) of a batch: how many more or fewer tickets a group has after it. ``kept`` has the batch's own
    rows, ``known`` those of the batches before it."""
    rows = kept.unionByName(known.join(kept.select("id"), "id", "left_semi"))
    earlier = F.col("batch") < batch
    first = F.min(F.when(F.col("uploaded").isNotNull(), F.struct("batch", "uploaded")))
    folded = rows.groupBy("id").agg(
        first.alias("_first"), F.max("decision").alias("_decision"), F.max("deleted").alias("_deleted"),
        F.max(F.when(earlier, F.col("decision"))).alias("_decided"), F.coalesce(F.max(earlier & F.col("deleted")), F.lit(False)).alias("_gone"))
    before = _present_group(F.when(F.col("_first.batch") < batch, F.col("_first.uploaded")), F.col("_decided"), F.col("_gone"))
    after = _present_group(F.col("_first.uploaded"), F.col("_decision"), F.col("_deleted"))
    moved = folded.select(before.alias("_before"), after.alias("_after")).filter(~F.col("_before").eqNullSafe(F.col("_after")))
    sides = F.array(F.struct(F.col("_before").alias("group"), F.lit(-1).alias("change")), F.struct(F.col("_after").alias("group"), F.lit(1).alias("change")))
    return moved.select(F.explode(sides).alias("_side")).filter("_side.group IS NOT NULL").select("_side.group.*", "_side.change").groupBy(
        *GROUP).agg(F.sum("change").alias("tickets"))


def live_review_stream(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of the present state in a parquet folder, as complete versions of the last few batches.

    The version of a batch is that of the batch before plus the batch's changes. A batch that is retried starts from
    the same version and replaces itself.
    """
    def save(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        _by_ticket(rows, batch).drop("batch").write.mode("overwrite").parquet(f"{checkpoint}/tickets/batch={batch}")
        log = spark.read.schema(_KEPT).parquet(f"{checkpoint}/tickets")
        own, known = (log.filter(F.col("batch") == batch), log.filter(F.col("batch") < batch))
        counted = stored(group_changes(own, known, batch), "changes")
        if batch:
            earlier = spark.read.parquet(f"{sink}/slot={(batch - 1) % _VERSIONS}").select(*GROUP, "tickets").filter("tickets <> 0")
            counted = counted.unionByName(earlier).groupBy(*GROUP).agg(F.sum("tickets").alias("tickets"))
        # A batch without any group still is a version: it gets one row that counts nothing.
        empty = spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (part.split() for part in _GROUP_SCHEMA.split(", "))],
                                      F.lit(0).cast("bigint").alias("tickets"))
        version = counted.filter("tickets <> 0").unionByName(empty)
        version.withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(
            f"{sink}/slot={batch % _VERSIONS}")

    return (events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def latest_review_counts(spark: SparkSession, sink: str) -> DataFrame:
    """Tickets by status, final labels and review, as of the newest version."""
    return latest_counts(spark, sink).filter("tickets <> 0").select(*GROUP, "tickets")


def kpis_from_review_counts(counts: DataFrame) -> DataFrame:
    """The status KPIs of the batch report, from live counts."""
    return analytics.kpi_counts(counts, weight="tickets")
