"""Review workflow on append-only decisions. Tickets are never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .tickets import pending

_CONTENT = ["decided_at", "kind", "decided_category", "decided_priority", "decided_department", "notes"]
LAST_DECISION = ("struct<decided_at: timestamp_ntz, kind: string, decided_category: string, decided_priority: string, "
                 "decided_department: string, notes: string>")

DECISION_SCHEMA = ("id bigint, kind string, decided_category string, decided_priority string, "
                   "decided_department string, notes string, decided_at timestamp_ntz")


def with_default_notes(decisions: DataFrame) -> DataFrame:
    """A manager override without notes gets the standard note; a resolution stays as it is."""
    blank = F.coalesce(F.col("notes"), F.lit("")) == ""
    return decisions.withColumn("notes", F.when(
        (F.col("kind") == "override") & blank, fixed.OVERRIDE_NOTE).otherwise(F.col("notes")))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each ticket; equal times are settled by the decision's content.

    The newest time of each ticket is a partial maximum in a hash table, so a ticket with many
    decisions costs one row per task. Only decisions of that time are compared by content.
    """
    newest = decisions.groupBy(F.col("id").alias("_id")).agg(F.max("decided_at").alias("_at"))
    last = decisions.join(newest, (F.col("id") == F.col("_id")) & (F.col("decided_at") == F.col("_at")), "left_semi")
    best = last.groupBy("id").agg(F.max(F.struct(*_CONTENT)).alias("last"))
    return best.select("id", "last.*")


def apply_decisions(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current state: final labels, notes and times of the latest decision; others unchanged.

    Predicted labels stay. A decision on an unknown ticket has no effect, see ``unknown_tickets``.
    """
    last = latest_decisions(with_default_notes(decisions))
    return _decided(tickets.join(last, "id", "left"), tickets.columns)


def fold_decisions(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """``tickets`` with the latest of their ``last_decision`` and of ``decisions``; the rest as it was uploaded.

    Decisions may come in any order and any number of times: the result is that of all of them at once.
    """
    newer = latest_decisions(with_default_notes(decisions)).select("id", F.struct(*_CONTENT).alias("_newer"))
    joined = tickets.join(newer, "id", "left").withColumn("last_decision", F.greatest("last_decision", "_newer"))
    return joined.select(*tickets.columns)


def present(tickets: DataFrame) -> DataFrame:
    """Current state of tickets that carry their ``last_decision``, as ``apply_decisions`` gives it."""
    columns = [c for c in tickets.columns if c != "last_decision"]
    return _decided(tickets.select(*columns, "last_decision.*"), columns)


def _decided(joined: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of tickets beside their latest decision, if any, as it changes them."""
    decided = F.col("decided_at").isNotNull()

    def pick(new: str | Column, old: str) -> Column:
        new = F.col(new) if isinstance(new, str) else new
        return F.when(decided, new).otherwise(F.col(old))

    changed = {
        "final_category": pick("decided_category", "final_category"),
        "final_priority": pick("decided_priority", "final_priority"),
        "final_department": pick("decided_department", "final_department"),
        "reviewer_notes": pick("notes", "reviewer_notes"),
        "is_reviewed": decided | F.col("is_reviewed"),
        "routing_status": pick(F.lit("RESOLVED"), "routing_status"),
        "reviewed_at": pick("decided_at", "reviewed_at"),
        "updated_at": pick("decided_at", "updated_at"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def unknown_tickets(decisions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Decisions whose ticket does not exist."""
    return decisions.join(tickets.select("id"), "id", "left_anti")


def pass_all(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Resolve every pending ticket with the standard note; labels unchanged."""
    waiting = (F.col("routing_status") == "HUMAN_REVIEW") & ~F.col("is_reviewed")
    changed = {
        "is_reviewed": F.col("is_reviewed") | waiting,
        "routing_status": F.when(waiting, "RESOLVED").otherwise(F.col("routing_status")),
        "reviewed_at": F.when(waiting, as_of).otherwise(F.col("reviewed_at")),
        "updated_at": F.when(waiting, as_of).otherwise(F.col("updated_at")),
        "reviewer_notes": F.when(waiting, fixed.PASS_ALL_NOTE).otherwise(F.col("reviewer_notes")),
    }
    return tickets.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in tickets.columns])


def pass_all_decisions(tickets: DataFrame, as_of: Column) -> DataFrame:
    """The decisions that resolve every pending ticket with the standard note; labels unchanged."""
    return pending(tickets).select(
        "id", F.lit("pass_all").alias("kind"), F.col("final_category").alias("decided_category"),
        F.col("final_priority").alias("decided_priority"), F.col("final_department").alias("decided_department"),
        F.lit(fixed.PASS_ALL_NOTE).alias("notes"), as_of.alias("decided_at"))


def pending_count(tickets: DataFrame, name: str) -> DataFrame:
    return pending(tickets).agg(F.count(F.lit(1)).alias(name))


def without_pending(tickets: DataFrame) -> DataFrame:
    """Delete the queue: everything but pending tickets."""
    return tickets.filter(~((F.col("routing_status") == "HUMAN_REVIEW") & ~F.col("is_reviewed")))


def tombstones(tickets: DataFrame) -> DataFrame:
    """Ids of pending tickets, to be stored as deletions."""
    return pending(tickets).select("id")


def without_deleted(tickets: DataFrame, deleted: DataFrame) -> DataFrame:
    return tickets.join(deleted.select("id"), "id", "left_anti")
