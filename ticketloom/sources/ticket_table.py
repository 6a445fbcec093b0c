"""One ticket table: batches of tickets, review decisions and deletions, each only ever appended.

Folder layout under the table's root:

* ``tickets/batch=<id>/created_month=<month>/``: a folder per batch, by month inside.
* ``filters/batch=<id>/``: the batch's ticket ids as a Bloom filter (``id_filter``).
* ``batches/``: a row per complete batch with its first id, size, and least and greatest ticket id. Readers see
  listed batches only, so a batch that broke off is invisible and is simply written again.
* ``cube/batch=<id>/``: the batch's tickets counted by hour, status and final labels.
* ``touched/``: tickets with a decision or deletion, as they were uploaded. It is written before the decision, so
  the cube less the touched tickets plus their present state is the cube of the present state at any time.
* ``refused/batch=<id>/``: rows of a batch that repeated a ticket id, where the batch was to set them aside.
* ``decisions/since=<version>/`` and ``deletions/since=<version>/``: append-only logs, by the snapshot that was the
  last one when a row was written. Repeating an append changes nothing.
* ``compacted/v<version>/``: a snapshot (``snapshot``), the tickets with their latest decision, without deleted ones, in
  buckets by id. ``snapshots/`` has a row per complete snapshot; readers take the newest one and what came after it.

One writer at a time is assumed; readers may come at any time.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..operators import analytics, ingest, review
from ..operators.ordering import number_rows
from ..scratch import stored
from . import id_filter, snapshot

_TEXTS = ("ticket_id customer_name contact_number review timestamp predicted_category predicted_priority "
          "predicted_department").split()
_LABELS = "final_category final_priority final_department".split()
SCHEMA = ("id bigint, " + ", ".join(f"{c} string" for c in _TEXTS)
          + ", confidence double, routing_status string, escalated boolean, escalation_reason string, "
          + ", ".join(f"{c} string" for c in _LABELS)
          + ", is_reviewed boolean, reviewer_notes string, model_version string, created_at timestamp_ntz, "
            "updated_at timestamp_ntz, reviewed_at timestamp_ntz")
_PLACE = "batch string, created_month string"
_BATCHES = "batch string, first_id bigint, tickets bigint, least_id string, greatest_id string"
_GROUP = ["routing_status", *_LABELS, "is_reviewed"]
_GROUP_SCHEMA = "routing_status string, " + ", ".join(f"{c} string" for c in _LABELS) + ", is_reviewed boolean"
_CUBE = f"hour timestamp_ntz, exact boolean, {_GROUP_SCHEMA}, tickets bigint, batch string"
_TOUCHED = f"id bigint, created_at timestamp_ntz, {_GROUP_SCHEMA}"
_DELETIONS = "id bigint, deleted_at timestamp_ntz"
_FOLDED = f"{SCHEMA}, last_decision {review.LAST_DECISION}"


class DuplicateTickets(ValueError):
    """A batch repeats a ticket id, its own or a stored one."""


class TicketTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        return self._log("batches", _BATCHES)

    def tickets(self, since_month: str | None = None, until_month: str | None = None, batches: list[str] | None = None) -> DataFrame:
        """Tickets as they were uploaded, deleted ones included; other months and batches are not read."""
        rows = self._log("tickets", f"{SCHEMA}, {_PLACE}")
        if batches is not None:
            rows = rows.filter(F.col("batch").isin(batches))
        if since_month is not None:
            rows = rows.filter(F.col("created_month") >= since_month)
        if until_month is not None:
            rows = rows.filter(F.col("created_month") <= until_month)
        return rows.join(self.batches().select("batch").distinct(), "batch", "left_semi").drop("batch", "created_month")

    def state(self, since_month: str | None = None, until_month: str | None = None) -> DataFrame:
        """Tickets as they are now: the latest decision of each, without deleted ones.

        Of the whole table this is the newest snapshot with what was logged since, and the batches since. Months are
        read from the batches, which are stored by month.
        """
        if since_month is not None or until_month is not None:
            live = review.without_deleted(self.tickets(since_month, until_month), self._deletions())
            return review.apply_decisions(live, self._decisions())
        return review.present(self._folded(self._newest_snapshot()))

    def _decisions(self, since: int = 0) -> DataFrame:
        """Decisions written when snapshot ``since`` was there or later."""
        return self._log("decisions", f"{review.DECISION_SCHEMA}, since int").filter(F.col("since") >= since).drop("since")

    def _deletions(self, since: int = 0) -> DataFrame:
        return self._log("deletions", f"{_DELETIONS}, since int").filter(F.col("since") >= since).drop("since")

    def _newest_snapshot(self) -> snapshot.Snapshot:
        newest = self._log("snapshots", snapshot.SCHEMA).orderBy(F.desc("version")).first()
        return snapshot.Snapshot(*newest) if newest else snapshot.NONE

    def _folded(self, at: snapshot.Snapshot) -> DataFrame:
        """Every present ticket as uploaded with its ``last_decision``, from snapshot ``at`` and what came after it.

        The snapshot is joined with the logs bucket by bucket, so its rows stay where they are; only the rows of
        the logs since and the tickets of the batches since are shuffled. A log row may be older than its
        ticket, so the new tickets are joined with all log rows of their ids.
        """
        newer = self.tickets(batches=[r.batch for r in self.batches().filter(F.col("first_id") >= at.below).select("batch").distinct().collect()]
                             if at.version else None)
        fresh = review.without_deleted(newer, self._deletions().filter(F.col("id") >= at.below))
        folded = review.fold_decisions(fresh.withColumn("last_decision", F.lit(None).cast(review.LAST_DECISION)),
                                       self._decisions().filter(F.col("id") >= at.below))
        if not at.version:
            return folded
        old = review.without_deleted(snapshot.read(self.spark, self.root, at, _FOLDED), self._deletions(at.version))
        return review.fold_decisions(old, self._decisions(at.version)).unionByName(folded)

    def compact(self, buckets: int | None = None) -> int:
        """Write the present tickets as the next snapshot and return its version. Readers see no difference.

        ``buckets`` (as many as shuffle partitions unless given) should let a bucket fit a task. A compaction that broke
        off is not listed and the next one replaces it.
        """
        at = self._newest_snapshot()
        below = self.batches().agg(F.max(F.col("first_id") + F.col("tickets"))).first()[0] or 1
        made = snapshot.Snapshot(at.version + 1, below, buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        snapshot.write(self._folded(at), self.root, made, _FOLDED)
        self.spark.createDataFrame([tuple(made)], snapshot.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")
        return made.version

    def refused(self) -> DataFrame:
        """Rows of complete batches that were set aside because their ticket id was taken."""
        rows = self._log("refused", f"{SCHEMA}, batch string")
        return rows.join(self.batches().select("batch").distinct(), "batch", "left_semi").drop("id")

    def append_batch(self, tickets: DataFrame, batch: str, set_aside: bool = False) -> None:
        """Store a batch in the layout of ``ingest.STORED`` under new ids. A batch that is already
        there is left as it is, so a retry has no effect.

        Rows whose ticket id is stored already, or came earlier in the batch, make the batch fail; with
        ``set_aside`` they go to the refused rows and the others are stored.
        """
        if not self.batches().filter(F.col("batch") == batch).isEmpty():
            return
        # Stored first: numbering reads its rows twice, and most batches come with their triage still to be done.
        # Numbered in order of upload: batch ids end in a row number without leading zeros beyond four.
        rows = number_rows(stored(tickets.select(*ingest.STORED), "upload"), [F.length("ticket_id"), F.col("ticket_id")], "_number")
        rows = stored(rows, "batch")
        repeated = stored(self._repeated(rows), "repeated")
        if not set_aside:
            some = [r.ticket_id for r in repeated.select("ticket_id").distinct().limit(5).collect()]
            if some:
                raise DuplicateTickets(f"ticket ids that repeat: {', '.join(map(str, some))}")
        extent = rows.agg(F.count(F.lit(1)).alias("n"), F.min("ticket_id").alias("least"), F.max("ticket_id").alias("greatest")).first()
        first = (self.batches().agg(F.max(F.col("first_id") + F.col("tickets"))).first()[0] or 1)
        accepted = rows.join(repeated.select("_number"), "_number", "left_anti")
        placed = accepted.select((F.col("_number") + F.lit(first - 1)).alias("id"), *ingest.STORED).withColumn(
            "created_month", F.date_format("created_at", "yyyy-MM"))
        (placed.hint("rebalance", "created_month").sortWithinPartitions("created_month", "created_at")
         .write.mode("overwrite").partitionBy("created_month").parquet(f"{self.root}/tickets/batch={batch}"))
        if set_aside:
            rows.join(repeated.select("_number"), "_number", "left_semi").select(*ingest.STORED).write.mode("overwrite").parquet(
                f"{self.root}/refused/batch={batch}")
        _counted(placed.withColumn("tickets", F.lit(1))).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cube/batch={batch}")
        id_filter.build(rows, id_filter.size_for(extent.n)).write.mode("overwrite").parquet(f"{self.root}/filters/batch={batch}")
        self.spark.createDataFrame([(batch, first, extent.n, extent.least, extent.greatest)], _BATCHES).coalesce(1).write.mode(
            "append").parquet(f"{self.root}/batches")

    def _repeated(self, rows: DataFrame) -> DataFrame:
        """(_number, ticket_id) of the rows whose ticket id came earlier in the batch or is stored.

        Batches are asked in turn: the list tells whose range of ids can meet the new one, their filters which
        ids they may hold, and only of the batches that answer are the ids read.
        """
        earliest = rows.groupBy("ticket_id").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        own = rows.select("_number", "ticket_id").join(
            earliest.select(F.col("ticket_id").alias("_id"), "_first"), F.col("ticket_id").eqNullSafe(F.col("_id"))).filter(
            "_number > _first").select("_number", "ticket_id")
        extent = rows.agg(F.min("ticket_id").alias("least"), F.max("ticket_id").alias("greatest")).first()
        if extent.least is None:
            return own
        meeting = self.batches().filter((F.col("least_id") <= extent.greatest) & (F.col("greatest_id") >= extent.least))
        names = [r.batch for r in meeting.select("batch").collect()]
        if not names:
            return own
        filters = self._log("filters", f"{id_filter.SCHEMA}, batch string").filter(F.col("batch").isin(names))
        answers = stored(id_filter.answers(rows, filters), "answers")
        answering = [r.batch for r in answers.select("batch").distinct().collect()]
        if not answering:
            return own
        taken = self.tickets(batches=answering).select("ticket_id").join(answers.select("ticket_id").distinct(), "ticket_id", "left_semi")
        known = rows.select("_number", "ticket_id").join(taken, "ticket_id", "left_semi").select("_number", "ticket_id")
        return own.unionByName(known).distinct()

    def decide(self, decisions: DataFrame) -> None:
        """Append resolutions or overrides; those of unknown tickets will have no effect."""
        names = [part.split()[0] for part in review.DECISION_SCHEMA.split(", ")]
        decisions = stored(decisions.select(*names), "decisions")
        self._touch(decisions)
        decisions.select(*names).write.mode("append").parquet(f"{self.root}/decisions/since={self._newest_snapshot().version}")

    def pass_all(self, as_of: Column) -> None:
        self.decide(review.pass_all_decisions(self.state(), as_of))

    def delete_pending(self, as_of: Column) -> None:
        self._delete(review.tombstones(self.state()), as_of)

    def delete_all(self, as_of: Column) -> None:
        self._delete(self.state().select("id"), as_of)

    def _delete(self, ids: DataFrame, as_of: Column) -> None:
        ids = stored(ids.select("id"), "deletions")
        self._touch(ids)
        ids.select("id", as_of.alias("deleted_at")).write.mode("append").parquet(
            f"{self.root}/deletions/since={self._newest_snapshot().version}")

    def _touch(self, changed: DataFrame) -> None:
        """Keep the uploaded form of the tickets of ``changed`` (id); only batches whose ids they can have are read."""
        extent = changed.agg(F.min("id").alias("least"), F.max("id").alias("greatest")).first()
        if extent.least is None:
            return
        meeting = self.batches().filter((F.col("first_id") <= extent.greatest) & (F.col("first_id") + F.col("tickets") > extent.least))
        names = [r.batch for r in meeting.select("batch").distinct().collect()]
        rows = self.tickets(batches=names).join(changed.select("id").distinct(), "id", "left_semi")
        rows.select("id", "created_at", *_GROUP).write.mode("append").parquet(f"{self.root}/touched")

    def cube(self) -> DataFrame:
        """Counts of the present state by hour, status and final labels; no ticket is read. ``exact`` tells
        tickets of the hour's first instant from the others."""
        uploaded = self._log("cube", _CUBE).join(self.batches().select("batch").distinct(), "batch", "left_semi")
        touched = self._log("touched", _TOUCHED).dropDuplicates(["id"])
        blank = {"reviewer_notes": "string", "reviewed_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
        before = touched.withColumns({name: F.lit(None).cast(kind) for name, kind in blank.items()})
        after = review.apply_decisions(review.without_deleted(before, self._deletions()), self._decisions())
        parts = [uploaded.drop("batch"), _counted(before.withColumn("tickets", F.lit(-1))), _counted(after.withColumn("tickets", F.lit(1)))]
        whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return whole.groupBy("hour", "exact", *_GROUP).agg(F.sum("tickets").alias("tickets")).filter("tickets <> 0")

    def trends(self, as_of: datetime, days: int = 7) -> DataFrame:
        """All trend items of the present state, from the cube. Where an edge of a window lies inside an hour, the
        tickets of that hour are read."""
        edges = [as_of - timedelta(days=n * days) for n in range(3)]
        cut = sorted({e.replace(minute=0, second=0, microsecond=0) for e in edges if e.minute or e.second or e.microsecond})
        hours = [F.lit(hour).cast("timestamp_ntz") for hour in cut]
        rows = self.cube().withColumn("created_at", F.when(F.col("exact"), F.col("hour")).otherwise(F.expr("hour + INTERVAL 30 MINUTES")))
        rows = rows.select("created_at", "tickets", *_GROUP)
        if hours:
            rows = rows.filter(~F.date_trunc("hour", "created_at").cast("timestamp_ntz").isin(hours))
            state = self.state(cut[0].strftime("%Y-%m"), cut[-1].strftime("%Y-%m"))
            own = reduce(lambda a, b: a | b, [(F.col("created_at") >= hour) & (F.col("created_at") < hour + F.expr("INTERVAL 1 HOUR")) for hour in hours])
            rows = rows.unionByName(state.filter(own).select("created_at", F.lit(1).cast("bigint").alias("tickets"), *_GROUP))
        return analytics.trends(rows, F.lit(as_of).cast("timestamp_ntz"), days, weight="tickets")


def _counted(tickets: DataFrame) -> DataFrame:
    """Sums of ``tickets`` by hour and group."""
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    return tickets.groupBy(hour.alias("hour"), (hour == F.col("created_at")).alias("exact"), *_GROUP).agg(F.sum("tickets").alias("tickets"))


def stream_into(table: TicketTable, requests: DataFrame, name: str, checkpoint: str, as_of: Column,
                threshold: float = fixed.CONFIDENCE_THRESHOLD) -> StreamingQuery:
    """Triage each arriving request and store it: defaults, id and layout as for a single ticket.

    Each micro-batch is a batch of the table, so one that is retried has no effect. A request without an id gets
    one of the micro-batch's number and its own place in it, so equal requests are tickets of their own; one
    whose id is taken is refused and the stream goes on. ``name`` belongs to the checkpoint: another
    checkpoint needs another name.
    """
    given = [c for c in ("ticket_id", "customer_name", "contact_number", "review", "timestamp") if c in requests.columns]
    empty = [F.lit(None).cast("string").alias(c) for c in ("ticket_id", "customer_name", "contact_number", "timestamp") if c not in given]

    def save(rows: DataFrame, number: int) -> None:
        # Places are stored with the rows: evaluated again they could be others.
        placed = stored(rows.select(*given, *empty, F.monotonically_increasing_id().alias("_place")), "requests")
        keyed = placed.withColumn("request_key", F.concat(F.lit(f"{name}-{number}-"), F.hex("_place"))).drop("_place")
        table.append_batch(ingest.triage_requests(keyed, as_of, threshold), f"{name}-{number}", set_aside=True)

    return (requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
