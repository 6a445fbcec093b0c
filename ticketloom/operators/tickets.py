"""Look-up, filter, search, paging and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .ingest import iso_text


def by_id(tickets: DataFrame, ticket: int) -> DataFrame:
    return tickets.filter(F.col("id") == ticket).limit(1)


def by_business_id(tickets: DataFrame, ticket_id: str) -> DataFrame:
    return tickets.filter(F.col("ticket_id") == ticket_id).limit(1)


def faceted(tickets: DataFrame, category: str | None = None, priority: str | None = None,
            department: str | None = None, routing_status: str | None = None) -> DataFrame:
    """Keep tickets that equal every given value; an empty value is no condition."""
    wanted = {"final_category": category, "final_priority": priority,
              "final_department": department, "routing_status": routing_status}
    for column, value in wanted.items():
        if value:
            tickets = tickets.filter(F.col(column) == value)
    return tickets


def search(tickets: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive search in text, name and id. ``%`` and ``_`` act as wildcards."""
    if not term:
        return tickets
    # A backslash is an ordinary character here, not an escape.
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return tickets.filter(F.col("review").ilike(pattern) | F.col("customer_name").ilike(pattern)
                          | F.col("ticket_id").ilike(pattern))


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def page(tickets: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest first (ties by id, newest first)."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1 and page size between 1 and 100")
    skip = (number - 1) * size
    # Only ids and times are ranked. At most 100 ids are left to look up.
    wanted = tickets.select("id", "created_at").orderBy(*_newest_first()).offset(skip).limit(size)
    return tickets.join(F.broadcast(wanted.select("id")), "id", "left_semi").orderBy(*_newest_first())


def page_totals(tickets: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One row: matching tickets and pages (one page when there are none)."""
    return tickets.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("bigint").alias("total_pages"))


def pending(tickets: DataFrame) -> DataFrame:
    return tickets.filter((F.col("routing_status") == "HUMAN_REVIEW") & ~F.col("is_reviewed"))


def review_queue(tickets: DataFrame, limit: int = 50) -> DataFrame:
    """Tickets that wait for a reviewer: escalated first, then newest."""
    if not 1 <= limit <= 10000:
        raise ValueError("limit must be between 1 and 10000")
    return pending(tickets).orderBy(F.desc("escalated"), *_newest_first()).limit(limit)


def response(tickets: DataFrame) -> DataFrame:
    """Tickets as an answer to a client: rounded confidence, times as ISO text."""
    shown = {"confidence": round_half_up(F.col("confidence"), 4)}
    for column in ("created_at", "updated_at", "reviewed_at"):
        shown[column] = iso_text(F.col(column))
    return tickets.withColumns(shown)


def empty(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete everything: the empty table and the count before."""
    return tickets.limit(0), tickets.agg(F.count(F.lit(1)).alias("deleted_count"))


