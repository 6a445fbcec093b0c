"""From uploaded rows to stored tickets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import percent
from ..functions.text import strip
from .triage import triage

STORED = ["ticket_id", "customer_name", "contact_number", "review", "timestamp",
          "predicted_category", "predicted_priority", "predicted_department", "confidence",
          "routing_status", "escalated", "escalation_reason", "final_category", "final_priority",
          "final_department", "is_reviewed", "reviewer_notes", "model_version",
          "created_at", "updated_at", "reviewed_at"]


def clean_reviews(df: DataFrame) -> DataFrame:
    """Strip the review and drop rows without one (null, blank, or the word "nan")."""
    review = strip(F.coalesce(F.col("review"), F.lit("")))
    # One test that names the review once: Spark writes out its expression wherever a filter names it.
    return df.withColumn("review", review).filter(~F.lower("review").isin("", "nan"))


def fill_defaults(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill missing name, contact and time of a batch row. A blank value is not missing."""
    return df.withColumns({
        "customer_name": F.coalesce(
            strip(F.col("customer_name")),
            F.concat(F.lit("Customer #"), F.col("row_number").cast("string"))),
        "contact_number": F.coalesce(strip(F.col("contact_number")), F.lit(fixed.UNKNOWN_CONTACT)),
        "timestamp": F.coalesce(strip(F.col("timestamp")), iso_text(as_of)),
    })


def iso_text(moment: Column) -> Column:
    """ISO text of a timestamp without zone; microseconds only when there are any."""
    plain = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(moment, "SSSSSS") == "000000", plain).otherwise(exact)


def batch_ticket_id(row_number: Column, batch_id: str) -> Column:
    number = row_number.cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(F.lit(f"TCK-CSV-{batch_id}-"), padded)


def batch_id_at(moment: datetime) -> str:
    """Minute-level id. Two uploads in one minute need different ids: pass your own then."""
    return moment.strftime("%Y%m%d%H%M")


def as_stored(triaged: DataFrame, as_of: Column) -> DataFrame:
    """Triage output in the layout of the ticket table."""
    return triaged.withColumns({
        "is_reviewed": F.lit(False),
        "reviewer_notes": F.lit(None).cast("string"),
        "created_at": as_of,
        "updated_at": as_of,
        "reviewed_at": F.lit(None).cast("timestamp_ntz"),
    }).select(*STORED)


def ingest_batch(uploaded: DataFrame, batch_id: str, as_of: Column,
                 threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Numbered upload rows to stored tickets. Row numbers of dropped rows leave gaps in the ids."""
    rows = fill_defaults(clean_reviews(uploaded), as_of).withColumn(
        "ticket_id", batch_ticket_id(F.col("row_number"), batch_id))
    return as_stored(triage(rows, threshold), as_of)


def batch_summary(tickets: DataFrame, batch_id: str) -> DataFrame:
    """One row: processed, routed and reviewed counts with the routing rate."""
    auto = F.col("routing_status") == "AUTO_ROUTED"
    return tickets.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(auto).alias("auto_routed_count"),
        F.count_if(~auto).alias("human_review_count"),
    ).withColumns({
        "auto_routing_rate": percent(F.col("auto_routed_count"), F.col("total_processed")),
        "batch_id": F.lit(batch_id),
    })


def sample_results(tickets: DataFrame, rows: int = 5) -> DataFrame:
    """The first stored tickets of a batch, in upload order."""
    return tickets.orderBy(F.length("ticket_id"), "ticket_id").limit(rows)


class EmptyReview(ValueError):
    """A single ticket came without usable text."""


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Single requests with usable text: at least three characters, not only white space."""
    review = F.coalesce(F.col("review"), F.lit(""))
    return requests.filter((F.length(review) >= 3) & (strip(review) != ""))


def triage_requests(requests: DataFrame, as_of: Column,
                    threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Single-ticket requests to stored tickets. Here a blank name, contact or time is missing. A request without an
    id gets one from its whole ``request_key``, which must be unique."""
    def filled(column: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), default)

    day = F.date_format(as_of, "yyyyMMdd")
    rows = accepted_requests(requests).withColumns({
        "review": strip(F.col("review")),
        "ticket_id": filled("ticket_id", F.concat(
            F.lit("TCK-"), day, F.lit("-"), F.upper("request_key"))),
        "customer_name": filled("customer_name", F.lit(fixed.UNKNOWN_CUSTOMER)),
        "contact_number": filled("contact_number", F.lit(fixed.UNKNOWN_CONTACT)),
        "timestamp": filled("timestamp", iso_text(as_of)),
    })
    return as_stored(triage(rows, threshold), as_of)


def triage_single(spark: SparkSession, ticket: dict, request_key: str, as_of: datetime,
                  threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """One request. ``request_key`` is a random hex text that makes the new id unique."""
    names = ["ticket_id", "customer_name", "contact_number", "review", "timestamp"]
    row = [ticket.get(n) for n in names] + [request_key]
    request = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names + ["request_key"]))
    if accepted_requests(request).isEmpty():
        raise EmptyReview("A ticket needs a complaint of at least three characters.")
    return triage_requests(request, F.lit(as_of).cast("timestamp_ntz"), threshold)
