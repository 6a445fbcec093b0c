"""One query per operator over the benchmark tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.numbers import round_half_up
from ..operators import (analytics, classifier, evalsets, extract, ingest, metrics, neardup, ordering,
                         quality, review, scenario, splits, tickets, triage)
from ..scratch import fresh_folder, stored
from ..sources import csv_tickets, records, search_index, store, ticket_table
from ..streaming import reviews as review_streams
from ..streaming import tickets as streams
from . import tickets as data

SEED = 42
BATCH_ID = "200108010000"
SEARCH = "rs_ 499%counter"
LOOKUP_ID = 1234

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- Shared inputs ----------------------------------------------------------------


def clean(spark, d, named=False):
    raw = data.named_tickets(spark, d) if named else data.raw_tickets(spark, d)
    return ingest.clean_reviews(raw)


def triaged(spark, d, named=False, threshold=fixed.CONFIDENCE_THRESHOLD):
    return triage.triage(clean(spark, d, named), threshold)


def stored_tickets(spark, d, named=False):
    """Tickets as the store holds them right after triage."""
    return triaged(spark, d, named).withColumns({
        "is_reviewed": F.lit(False),
        "reviewer_notes": F.lit(None).cast("string"),
        "updated_at": F.col("created_at"),
        "reviewed_at": F.lit(None).cast("timestamp_ntz"),
    })


def current_tickets(spark, d, named=False):
    return review.apply_decisions(stored_tickets(spark, d, named), data.decisions(spark, d))


def documents(spark, d):
    return data.table(spark, d, "documents")


def predictions(spark, d):
    """Model outputs against true labels, with the heuristic confidence."""
    rows = triage.with_confidence(triage.with_keyword_labels(clean(spark, d))).select(
        "id", "category", "priority", "department", "confidence")
    true = {f"true_{t}": F.col(t) for t in metrics.TASKS}
    out = extract.extract_labels(data.model_outputs(rows).withColumns(true))
    return out.select("id", *true, *[F.col(t).alias(f"pred_{t}") for t in metrics.TASKS],
                      "confidence", "raw_valid")


def text_views(spark, d):
    return triage.with_text_views(clean(spark, d))


def iso(column):
    return ingest.iso_text(F.col(column)).alias(column)


STATE = ["id", "final_category", "final_priority", "final_department", "routing_status",
         "is_reviewed", "reviewer_notes"]


# --- A. Sources and sinks -----------------------------------------------------------


def _upload_folder(spark, d, in_order=False):
    folder = fresh_folder(spark, "upload")
    rows = data.named_tickets(spark, d)
    (rows.orderBy("id") if in_order else rows).select(
        F.col("customer_name").alias(" Customer "), F.col("contact_number").alias("PHONE"),
        F.col("review").alias("Complaint"), F.col("timestamp").alias("Date"),
        F.col("id").cast("string").alias("Number"),
    ).write.csv(folder, header=True, quote='"', escape='"',
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


@query
def a1_csv_source(spark, d):
    return csv_tickets.read_tickets_csv(spark, _upload_folder(spark, d)).drop("row_number")


@query
def a1_csv_row_numbers(spark, d):
    rows = csv_tickets.read_tickets_csv(spark, _upload_folder(spark, d))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min("row_number").alias("first_row"),
                    F.max("row_number").alias("last_row"),
                    F.count_distinct("row_number").alias("distinct_rows"))


@query
def a2_upload_preview(spark, d):
    return csv_tickets.preview(spark, _upload_folder(spark, d, in_order=True))


def _record_folder(spark, d):
    folder = fresh_folder(spark, "records")
    records.write_records(records.nest(data.labelled_records(spark, d)), folder)
    return folder


@query
def a3_jsonl_source(spark, d):
    return records.read_records(spark, _record_folder(spark, d)).select("fields.*", records.CORRUPT)


@query
def a4_jsonl_sink(spark, d):
    lines = spark.read.text(_record_folder(spark, d))
    return lines.select(F.get_json_object("value", "$.fields.ticket_id").alias("ticket_id"),
                        F.get_json_object("value", "$.metadata.key_index").alias("key_index"))


@query
def a5_csv_sink(spark, d):
    folder = fresh_folder(spark, "csv")
    csv_tickets.write_csv(data.labelled_records(spark, d), folder)
    return spark.read.csv(folder, header=True, escape='"')


@query
def a6_master_flatten(spark, d):
    return records.flatten(records.nest(data.labelled_records(spark, d)))


@query
def a7_ticket_append(spark, d):
    folder = fresh_folder(spark, "tickets")
    rows = stored(stored_tickets(spark, d), "triaged")
    store.append_tickets(rows.filter("escalated"), folder)
    store.append_tickets(rows.filter("not escalated"), folder)
    return store.read_tickets(spark, folder).select("id", "routing_status", iso("created_at"))


@query
def a8_upload_projection(spark, d):
    return store.upload_projection(data.named_tickets(spark, d))


# --- B. Ingest ----------------------------------------------------------------------


@query
def b1_clean_reviews(spark, d):
    return clean(spark, d).select("id", "review")


@query
def b2_defaults(spark, d):
    rows = data.gappy_tickets(spark, d).withColumn("row_number", F.col("id") + 1)
    return ingest.fill_defaults(rows, data.as_of()).select(
        "id", "customer_name", "contact_number", "timestamp")


@query
def b3_batch_ticket_ids(spark, d):
    rows = ordering.number_rows(data.raw_tickets(spark, d).select("id", "review"), ["id"])
    return ingest.clean_reviews(rows).select(
        "id", ingest.batch_ticket_id(F.col("row_number"), BATCH_ID).alias("ticket_id"))


@query
def b4_batch_summary(spark, d):
    return ingest.batch_summary(triaged(spark, d), BATCH_ID)


@query
def b4_sample_results(spark, d):
    rows = data.gappy_tickets(spark, d).withColumn("row_number", F.col("id") + 1)
    batch = ingest.ingest_batch(rows, BATCH_ID, data.as_of())
    return ingest.sample_results(batch).select("ticket_id", "customer_name", "confidence", "routing_status")


@query
def b5_single_requests(spark, d):
    requests = data.gappy_tickets(spark, d).withColumns(
        {"ticket_id": F.lit(None).cast("string"), "request_key": F.md5(F.col("id").cast("string"))})
    return ingest.triage_requests(requests, data.as_of()).select(
        "ticket_id", "customer_name", "contact_number", "timestamp", "confidence", "routing_status")


def _order_stream(spark, d):
    # The pattern fits a single file as well as a folder of files.
    schema = data.table(spark, d, "orders").schema
    files = streams.read_ticket_files(spark, f"{d}/orders.parquet*", schema)
    return data.project(files, data.RAW_COLUMNS)


@query
def b6_triage_stream(spark, d):
    sink = fresh_folder(spark, "stream")
    streams.triage_stream(_order_stream(spark, d), f"{sink}/out", f"{sink}/state").awaitTermination()
    return spark.read.parquet(f"{sink}/out").select("id", "confidence", "final_priority", "routing_status")


# --- C. Scoring, safety and routing ----------------------------------------------------


@query
def c1_category_rule(spark, d):
    return triage.with_keyword_labels(clean(spark, d)).select(
        "id", "predicted_category", "predicted_department")


@query
def c2_priority_rule(spark, d):
    return triage.with_keyword_labels(clean(spark, d)).select("id", "predicted_priority")


@query
def c3_matched_keywords(spark, d):
    return triage.with_keyword_labels(clean(spark, d)).select(
        "id", F.col("matched_keywords").cast("bigint").alias("matched_keywords"))


def _term(name):
    def run(spark, d):
        rows = triage.with_confidence_terms(triage.with_keyword_labels(clean(spark, d)))
        return rows.select("id", f"term_{name}")
    return run


for _letter, _name in zip("abcdef", ("base", "hits", "length", "signals", "vocabulary", "jitter")):
    QUERIES[f"c4{_letter}_{_name}_term"] = _term(_name)


@query
def c4_confidence(spark, d):
    return triage.with_confidence(triage.with_keyword_labels(clean(spark, d))).select("id", "confidence")


@query
def c5_token_confidence(spark, d):
    outputs = data.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("valid"))
    tokens = data.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.lit(1.0) - F.col("l_discount")).alias("p"))
    return extract.confidence_by_output(outputs, tokens, "id", "p", "valid").select("id", "confidence")


@query
def c6_label_extraction(spark, d):
    return extract.extract_labels(data.model_outputs(data.raw_tickets(spark, d))).select(
        "id", "category", "priority", "department", "raw_valid")


@query
def c7_critical_escalation(spark, d):
    reason = triage.escalation_reason(F.col("_folded"), F.col("_ascii"), F.col("_signs"))
    return text_views(spark, d).select("id", reason.alias("escalation_reason")).withColumn(
        "escalated", F.col("escalation_reason").isNotNull())


@query
def c8_high_boost(spark, d):
    return triaged(spark, d).select("id", "predicted_priority", "final_priority")


def _pairs(spark, d):
    return data.project(data.table(spark, d, "lineitem"), data.PAIR_COLUMNS)


@query
def c9_department_correction(spark, d):
    fixed_department = triage.corrected_department(F.col("category"), F.col("department"))
    return _pairs(spark, d).withColumn("corrected", fixed_department).groupBy(
        "category", "department", "corrected").agg(F.count(F.lit(1)).alias("n"))


@query
def c10_routing(spark, d):
    scored = triage.with_confidence(triage.with_keyword_labels(clean(spark, d)))
    return triage.with_safety(scored, 0.85).select("id", "routing_status", "confidence_passed")


@query
def c11_triage(spark, d):
    return triaged(spark, d).select("id", *triage.OUTPUT)


@query
def c12_trained_classifier(spark, d):
    rows = clean(spark, d).select("id", "review", "category", "priority", "department")
    train, test = splits.stratified_split(rows, "id", fixed.TEST_SHARE, SEED)
    return classifier.fit(stored(train, "train")).score(test)


@query
def c12_classifier_check(spark, d):
    """One row: every held-out ticket is scored, with known labels, better than by the commonest one."""
    rows = stored(clean(spark, d).select("id", "review", "category", "priority", "department"), "labelled")
    train, test = splits.stratified_split(rows, "id", fixed.TEST_SHARE, SEED)
    scored = classifier.fit(stored(train, "train")).score(test)
    known = {"category": fixed.CATEGORIES, "priority": fixed.PRIORITIES, "department": fixed.DEPARTMENTS}
    odd = [~F.col(f"predicted_{t}").isin(labels) for t, labels in known.items()]
    counts = [F.count_if(F.col("department") == v).alias(f"n{i}") for i, v in enumerate(fixed.DEPARTMENTS)]
    return scored.agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(odd[0] | odd[1] | odd[2]).alias("unknown_labels"),
        F.count_if(~F.col("confidence").between(0, 1)).alias("odd_confidences"),
        F.count_if(F.col("predicted_department") == F.col("department")).alias("right"), *counts,
    ).select("scored", "unknown_labels", "odd_confidences",
             (F.col("right") > F.greatest(*[f"n{i}" for i in range(len(counts))])).alias("beats_commonest"))


@query
def c13_phone_masking(spark, d):
    customer = data.table(spark, d, "customer")
    return customer.select("c_custkey", tx.mask_phone(F.expr(data.PHONE)).alias("masked"))


@query
def c14_card_masking(spark, d):
    return documents(spark, d).select("doc_id", tx.mask_cards(F.col("text")).alias("masked"))


@query
def c15_code_masking(spark, d):
    return clean(spark, d).select("id", tx.sanitize(F.col("review")).alias("masked"))


@query
def c15_sanitized_documents(spark, d):
    return documents(spark, d).select("doc_id", tx.sanitize(F.col("text")).alias("masked"))


@query
def c16_rescore(spark, d):
    old = current_tickets(spark, d).withColumn("confidence", F.lit(0.92))
    return triage.rescore(old, data.as_of()).select("id", "confidence", "routing_status", iso("updated_at"))


# --- D. Tickets and review ------------------------------------------------------------


@query
def d1_by_id(spark, d):
    return tickets.by_id(current_tickets(spark, d), LOOKUP_ID).select(*STATE)


@query
def d1_by_business_id(spark, d):
    return tickets.by_business_id(current_tickets(spark, d), f"TCK-{LOOKUP_ID}").select(*STATE)


@query
def d2_faceted_filter(spark, d):
    return tickets.faceted(current_tickets(spark, d), category="Billing", priority="High",
                           department="", routing_status="AUTO_ROUTED").select(*STATE)


@query
def d3_keyword_search(spark, d):
    return tickets.search(current_tickets(spark, d, named=True), SEARCH).select("id", "customer_name")


@query
def d3_name_search(spark, d):
    return tickets.search(current_tickets(spark, d, named=True), "customer%7").select("id", "customer_name")


@query
def d4_page(spark, d):
    return tickets.page(current_tickets(spark, d), 3, 20).select("id", iso("created_at"))


@query
def d4_page_totals(spark, d):
    return tickets.page_totals(tickets.faceted(current_tickets(spark, d), category="Refund"), 3, 20)


@query
def d5_review_queue(spark, d):
    return tickets.review_queue(current_tickets(spark, d)).select("id", "escalated", iso("created_at"))


@query
def d6_resolve(spark, d):
    done = data.decisions(spark, d).filter("kind = 'resolve'")
    return review.apply_decisions(stored_tickets(spark, d), done).select(*STATE, iso("reviewed_at"), iso("updated_at"))


@query
def d7_override(spark, d):
    done = data.decisions(spark, d).filter("kind = 'override'")
    return review.apply_decisions(stored_tickets(spark, d), done).select(*STATE, iso("reviewed_at"), iso("updated_at"))


@query
def d8_pass_all(spark, d):
    return review.pass_all(current_tickets(spark, d), data.as_of()).select(*STATE, iso("reviewed_at"))


@query
def d8_pass_all_count(spark, d):
    return review.pending_count(current_tickets(spark, d), "resolved_count")


@query
def d9_delete_pending(spark, d):
    return review.without_pending(current_tickets(spark, d)).select(*STATE)


@query
def d9_deleted_count(spark, d):
    return review.pending_count(current_tickets(spark, d), "deleted_count")


@query
def d10_delete_all(spark, d):
    return tickets.empty(current_tickets(spark, d))[1]


@query
def d12_ticket_table(spark, d):
    """Two uploads with reviews in between: decide, pass all, upload again, delete what waits."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "ticket-table"))
    uploads = ingest.as_stored(triage.triage(clean(spark, d, named=True)), data.as_of())
    first, second = uploads.filter(_order_number() % 2 == 0), uploads.filter(_order_number() % 2 == 1)
    table.append_batch(first, "first")
    ids = table.state().select(F.col("id").alias("_id"), "ticket_id")
    decided = data.decisions(spark, d).filter("kind = 'resolve'").withColumn(
        "ticket_id", F.concat(F.lit("TCK-"), F.col("id").cast("string"))).join(ids, "ticket_id")
    table.decide(decided.withColumn("id", F.col("_id")))
    table.pass_all(data.as_of())
    table.append_batch(second, "second")
    table.append_batch(second, "second")
    table.delete_pending(data.as_of())
    return table.state().select("ticket_id", *STATE)


@query
def d12_compacted_table(spark, d):
    """The history of ``d12_ticket_table`` with a snapshot after each of its steps but the last."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "compacted-table"))
    uploads = ingest.as_stored(triage.triage(clean(spark, d, named=True)), data.as_of())
    table.append_batch(uploads.filter(_order_number() % 2 == 0), "first")
    table.compact()
    table.decide(_numbered_decisions(spark, d, table).filter("kind = 'resolve'"))
    table.compact()
    table.pass_all(data.as_of())
    table.append_batch(uploads.filter(_order_number() % 2 == 1), "second")
    table.compact()
    table.delete_pending(data.as_of())
    return table.state().select("ticket_id", *STATE)


def _numbered_decisions(spark, d, table):
    """The decisions of the benchmark tables with the ids that a ticket table gave to their tickets."""
    ids = table.tickets().select(F.col("id").alias("_id"), "ticket_id")
    named = data.decisions(spark, d).withColumn("ticket_id", F.concat(F.lit("TCK-"), F.col("id").cast("string")))
    return named.join(ids, "ticket_id").withColumn("id", F.col("_id"))


def _snapshot_state(spark, d):
    """Present tickets from a snapshot of half the tickets and overrides, what was decided since, and a batch since."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "snapshot"))
    uploads = stored(ingest.as_stored(triage.triage(clean(spark, d, named=True)), F.col("created_at").cast("timestamp_ntz")), "uploads")
    table.append_batch(uploads.filter(_order_number() % 2 == 0), "even")
    table.decide(_numbered_decisions(spark, d, table).filter("kind = 'override'"))
    table.compact()
    table.decide(_numbered_decisions(spark, d, table).filter("kind <> 'override'"))
    table.append_batch(uploads.filter(_order_number() % 2 == 1), "odd")
    table.decide(_numbered_decisions(spark, d, table))
    return table.state()


@query
def d1_snapshot_lookup(spark, d):
    found = tickets.by_business_id(_snapshot_state(spark, d), f"TCK-{LOOKUP_ID}")
    return found.withColumn("id", _order_number()).select(*STATE)


@query
def d2_snapshot_filter(spark, d):
    rows = _snapshot_state(spark, d).withColumn("id", _order_number())
    return tickets.faceted(rows, category="Billing", priority="High", department="", routing_status="AUTO_ROUTED").select(*STATE)


@query
def d5_snapshot_queue(spark, d):
    rows = _snapshot_state(spark, d).withColumn("id", _order_number())
    return tickets.review_queue(rows).select("id", "escalated", iso("created_at"))


@query
def e6_snapshot_summary(spark, d):
    return analytics.summary_flat(_snapshot_state(spark, d))


def _indexed_search(spark, d, term):
    """A search of tickets of which half are in the index, and a batch came after it."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "indexed"))
    index = search_index.SearchIndex(table)
    uploads = stored(ingest.as_stored(triage.triage(clean(spark, d, named=True)), F.col("created_at").cast("timestamp_ntz")), "uploads")
    table.append_batch(uploads.filter(_order_number() % 2 == 0), "even")
    index.extend()
    table.append_batch(uploads.filter(_order_number() % 2 == 1), "odd")
    return index.search(term).select(_order_number().alias("id"), "customer_name")


@query
def d3_indexed_search(spark, d):
    return _indexed_search(spark, d, SEARCH)


@query
def d3_indexed_name_search(spark, d):
    return _indexed_search(spark, d, "customer%7")


def _order_number():
    return F.substring_index("ticket_id", "-", -1).cast("bigint")


@query
def b6_stream_into_table(spark, d):
    folder = fresh_folder(spark, "stream-table")
    table = ticket_table.TicketTable(spark, f"{folder}/table")
    requests = ingest.clean_reviews(_order_stream(spark, d))
    ticket_table.stream_into(table, requests, "orders", f"{folder}/state", data.as_of()).awaitTermination()
    return table.state().select("id", "ticket_id", "customer_name", "confidence", "final_priority", "routing_status")


def _request_files(spark, folder, requests):
    """Requests in six files, streamed two at a time."""
    requests.repartition(6).write.parquet(folder)
    return streams.read_ticket_files(spark, folder, requests.schema, "*.parquet", files_per_batch=2)


@query
def b6_stream_without_ids(spark, d):
    """Requests without an id, most of them equal to others, in several micro-batches that come twice."""
    folder = fresh_folder(spark, "requests")
    requests = _request_files(spark, f"{folder}/in", clean(spark, d).select("review"))
    table = ticket_table.TicketTable(spark, f"{folder}/table")
    for state in ("state", "state-again"):
        ticket_table.stream_into(table, requests, "web", f"{folder}/{state}", data.as_of()).awaitTermination()
    return table.state().groupBy("review", "routing_status").agg(
        F.count(F.lit(1)).alias("tickets"), F.count_distinct("ticket_id").alias("ids"))


@query
def b6_stream_refused(spark, d):
    """Requests that name their own id, many of which are taken: one ticket an id, the others refused."""
    folder = fresh_folder(spark, "requests")
    customers = data.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("own_id"))
    named = clean(spark, d).select("id", "review").join(customers, "id").select(F.col("own_id").alias("ticket_id"), "review")
    table = ticket_table.TicketTable(spark, f"{folder}/table")
    ticket_table.stream_into(table, _request_files(spark, f"{folder}/in", named), "shop", f"{folder}/state", data.as_of()).awaitTermination()
    rows = table.tickets().select("ticket_id", F.lit(1).alias("stored")).unionByName(table.refused().select("ticket_id", F.lit(0).alias("stored")))
    return rows.groupBy("ticket_id").agg(F.sum("stored").cast("bigint").alias("tickets"), F.sum(1 - F.col("stored")).cast("bigint").alias("refused"))


@query
def a7_unique_append(spark, d):
    """Three batches that overlap; what repeats a stored id is set aside."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "unique-append"))
    uploads = stored(ingest.as_stored(triage.triage(clean(spark, d, named=True)), data.as_of()), "uploads")
    for number in range(3):
        table.append_batch(uploads.filter((_order_number() % 4).isin(number, number + 1)), f"b{number}", set_aside=True)
    refused = table.refused().groupBy("ticket_id").agg(F.count(F.lit(1)).alias("refused"))
    return table.state().select("ticket_id", "routing_status").join(refused, "ticket_id", "left").select(
        "ticket_id", "routing_status", F.coalesce("refused", F.lit(0)).cast("bigint").alias("refused"))


@query
def d11_response(spark, d):
    return tickets.response(current_tickets(spark, d, named=True)).select(
        "ticket_id", "customer_name", "review", "confidence", "created_at", "updated_at", "reviewed_at")


# --- E. Analytics -----------------------------------------------------------------------


@query
def e1_kpi_counts(spark, d):
    return analytics.kpi_counts(current_tickets(spark, d))


@query
def e2_routing_rate(spark, d):
    return analytics.routing_rate(current_tickets(spark, d))


@query
def e3_average_confidence(spark, d):
    return analytics.average_confidence(current_tickets(spark, d))


@query
def e4_category_breakdown(spark, d):
    return analytics.breakdown(current_tickets(spark, d), "category")


@query
def e5_priority_breakdown(spark, d):
    return analytics.breakdown(current_tickets(spark, d), "priority")


@query
def e6_department_breakdown(spark, d):
    return analytics.breakdown(current_tickets(spark, d), "department")


@query
def e6_summary(spark, d):
    return analytics.summary_flat(current_tickets(spark, d))


@query
def e7_percentage_change(spark, d):
    at = F.col("o_orderdate")
    counts = data.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count_if(at >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("current"),
        F.count_if(at < F.lit("1996-01-01").cast("timestamp_ntz")).alias("previous"))
    return analytics.with_change(counts)


@query
def e8_summary_trends(spark, d):
    return analytics.summary_trends(current_tickets(spark, d), data.as_of())


@query
def e9_category_trends(spark, d):
    return analytics.label_trends(current_tickets(spark, d), *analytics.LABEL_GROUPS["category"], data.as_of(), 30)


@query
def e9_event_trends(spark, d):
    labels = ["click", "view", "purchase", "error", "signup"]
    return analytics.label_trends(data.table(spark, d, "events"), "event_type", labels,
                                  data.as_of(data.EVENTS_AS_OF), 7, "ts")


@query
def e10_priority_trends(spark, d):
    return analytics.label_trends(current_tickets(spark, d), *analytics.LABEL_GROUPS["priority"], data.as_of(), 30)


@query
def e11_department_trends(spark, d):
    return analytics.label_trends(current_tickets(spark, d), *analytics.LABEL_GROUPS["department"], data.as_of(), 30)


@query
def e11_all_trends(spark, d):
    return analytics.trends(current_tickets(spark, d), data.as_of(), 30)


@query
def e11_trends_from_cube(spark, d):
    """All trends from the hourly counts of a ticket table, after decisions; no stored ticket is read for them."""
    table = ticket_table.TicketTable(spark, fresh_folder(spark, "trend-table"))
    uploads = ingest.as_stored(triage.triage(clean(spark, d, named=True)), F.col("created_at").cast("timestamp_ntz"))
    for half in (0, 1):
        table.append_batch(uploads.filter(_order_number() % 2 == half), f"half-{half}")
    ids = table.tickets().select(F.col("id").alias("_id"), "ticket_id")
    decided = data.decisions(spark, d).withColumn("ticket_id", F.concat(F.lit("TCK-"), F.col("id").cast("string"))).join(ids, "ticket_id")
    table.decide(decided.withColumn("id", F.col("_id")))
    return table.trends(datetime.fromisoformat(data.AS_OF), 30)


@query
def e12_live_kpis(spark, d):
    sink = fresh_folder(spark, "live")
    rows = triage.triage(ingest.clean_reviews(_order_stream(spark, d)))
    streams.live_kpi_stream(rows, f"{sink}/out", f"{sink}/state").awaitTermination()
    return streams.latest_counts(spark, f"{sink}/out")


@query
def e12_live_review_kpis(spark, d):
    """KPIs from a stream of uploads, decisions and deletions (of every 13th ticket), two files of each at a time."""
    folder = fresh_folder(spark, "live-reviews")
    events = {"uploads": stored_tickets(spark, d).select("id", *review_streams.GROUP), "decisions": data.decisions(spark, d),
              "deletions": data.raw_tickets(spark, d).filter("id % 13 = 0").select("id")}
    arriving = {}
    for name, rows in events.items():
        rows.repartition(6).write.parquet(f"{folder}/{name}")
        arriving[name] = streams.read_ticket_files(spark, f"{folder}/{name}", rows.schema, "*.parquet", files_per_batch=2)
    stream = review_streams.review_events(arriving["uploads"], arriving["decisions"], arriving["deletions"])
    review_streams.live_review_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return review_streams.kpis_from_review_counts(review_streams.latest_review_counts(spark, f"{folder}/out"))


# --- F. Data quality ----------------------------------------------------------------------


def _words(spark, d, table="documents"):
    rows = store.balanced(data.table(spark, d, table))
    return rows.withColumn("words", tx.normalized_words(F.col("text")))


@query
def f1_normalised_words(spark, d):
    return _words(spark, d).select("doc_id", F.array_join("words", " ").alias("words"),
                                   F.size("words").cast("bigint").alias("n_words"))


@query
def f2_shingles(spark, d):
    sets = _words(spark, d).withColumn("s", tx.shingles(F.col("words")))
    return sets.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"),
                       F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query
def f3_jaccard(spark, d):
    sets = _words(spark, d, "conversations").withColumn("s", tx.shingles(F.col("words")))
    here = sets.select("conv_id", "turn", "s")
    after = sets.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("next"))
    return here.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", tx.jaccard(F.col("s"), F.col("next")).alias("jaccard"))


@query
def f4_near_duplicate_matches(spark, d):
    return neardup.near_duplicate_matches(documents(spark, d), "doc_id", "text", "lang")


@query
def f5_near_dedup(spark, d):
    return neardup.keep_first_similar(documents(spark, d).select("doc_id", "text", "lang"),
                                      "doc_id", "text", "lang").select("doc_id")


def _checked(spark, d):
    checked = quality.flag_departments(quality.validate_records(data.record_lines(spark, d)))
    return stored(checked, "checked")


@query
def f6_validation(spark, d):
    return _checked(spark, d).select("line_no", "valid", F.array_join("reasons", "; ").alias("reasons"))


@query
def f7_department_legitimacy(spark, d):
    return quality.flag_departments(_pairs(spark, d)).groupBy("category", "department", "suspicious").agg(
        F.count(F.lit(1)).alias("n"))


@query
def f8_distribution(spark, d):
    return quality.distribution(_checked(spark, d).filter("valid"))


@query
def f8_totals(spark, d):
    return quality.validation_totals(_checked(spark, d))


@query
def f9_exception_samples(spark, d):
    return quality.exception_samples(_checked(spark, d))


@query
def f10_combinations(spark, d):
    return quality.combinations(data.raw_tickets(spark, d))


@query
def f11_imbalance(spark, d):
    return quality.imbalance(data.raw_tickets(spark, d))


@query
def f12_duplicate_ids(spark, d):
    return quality.duplicate_ids(data.table(spark, d, "conversations"), "conv_id")


@query
def f12_id_totals(spark, d):
    return quality.id_totals(data.table(spark, d, "conversations"), "conv_id")


def _line_tickets(spark, d):
    return data.table(spark, d, "lineitem").select(
        F.concat(F.lit("TCK-"), F.col("l_orderkey").cast("string")).alias("ticket_id"))


@query
def f13_sequence_gaps(spark, d):
    return quality.sequence_gaps(_line_tickets(spark, d)).select(
        F.col("first_missing").cast("bigint"), F.col("last_missing").cast("bigint"))


@query
def f13_sequence_totals(spark, d):
    totals = quality.sequence_totals(_line_tickets(spark, d))
    return totals.select(*[F.col(c).cast("bigint") for c in totals.columns])


@query
def f13_unreadable_numbers(spark, d):
    """Ids with a number of 39 digits or more, which the reports leave out; lines of partkey 7 get one."""
    long = F.when(F.col("l_partkey") % 7 == 0, F.lpad(F.col("l_orderkey").cast("string"), 39, "9")).otherwise(F.col("l_orderkey").cast("string"))
    lines = data.table(spark, d, "lineitem").select(F.concat(F.lit("TCK-"), long).alias("ticket_id"))
    return quality.unreadable_numbers(lines)


@query
def f14_keep_first(spark, d):
    return quality.keep_first(data.table(spark, d, "conversations"), "conv_id", "turn").select(
        "conv_id", "turn", "text")


@query
def f15_progress(spark, d):
    found = quality.progress(data.labelled_records(spark, d).withColumn("line_no", F.col("id")))
    return found.withColumn("next_index", F.col("next_index").cast("bigint"))


@query
def f16_completeness(spark, d):
    rows = quality.missing_fields(data.gappy_tickets(spark, d))
    return rows.select("id", F.array_join("missing", ",").alias("missing"))


@query
def f16_complete_rows(spark, d):
    return quality.complete_rows(data.gappy_tickets(spark, d)).select("id")


# --- G. Splits and evaluation sets ------------------------------------------------------------


def _document_strata():
    return F.concat_ws("|", "lang", "source")


@query
def g1_stratified_split(spark, d):
    return splits.stratified_test_ids(documents(spark, d), "doc_id", _document_strata(), "0.30", SEED)


@query
def g1_ticket_split(spark, d):
    rows = clean(spark, d)
    return splits.stratified_test_ids(rows, "id", splits.combination(), fixed.FUTURE_SHARE, SEED)


@query
def g2_stratum_fallback(spark, d):
    fine = F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string"))
    _, test = splits.stratified_split(documents(spark, d), "doc_id", "0.30", SEED, fine, F.col("lang"))
    return test.select("doc_id")


def _labelled_and_other(spark, d):
    docs, labels = documents(spark, d), data.table(spark, d, "labels").select("doc_id").distinct()
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


@query
def g3_leakage_removal(spark, d):
    base, other = _labelled_and_other(spark, d)
    return neardup.without_near_rows(base, other, "doc_id", "text").select("doc_id")


@query
def g4_split_sizes(spark, d):
    parts = splits.split_dataset(documents(spark, d).select("doc_id", "text", "lang", "source"),
                                 "doc_id", "text", SEED, _document_strata(), F.col("lang"))
    return splits.split_sizes(parts)


@query
def g4_split_invariants(spark, d):
    """One row: the size of the future set, and what must be zero of the other parts."""
    docs = documents(spark, d).select("doc_id", "text", "lang", "source")
    parts = splits.split_dataset(docs, "doc_id", "text", SEED, _document_strata(), F.col("lang"))
    held = parts["validation"].unionByName(parts["test"])
    rest = parts["train"].unionByName(held)
    every = rest.unionByName(parts["future_test"])
    measures = {
        "future_rows": parts["future_test"],
        "repeated_rows": every.groupBy("doc_id").count().filter("count > 1"),
        "foreign_rows": every.join(docs, "doc_id", "left_anti"),
        "near_future": neardup.near_rows(parts["future_test"], rest, "doc_id", "text"),
        "near_train": neardup.near_rows(parts["train"], held, "doc_id", "text"),
    }
    counts = [F.lit(rows.count()).cast("bigint").alias(name) for name, rows in measures.items()]
    return spark.range(1).select(*counts)


@query
def g5_rows_with_ids(spark, d):
    return evalsets.rows_with_ids(data.labelled_records(spark, d), _line_tickets(spark, d)).select(
        "ticket_id", "review", "difficulty", "scenario_type")


@query
def g6_edge_cases(spark, d):
    return evalsets.edge_cases(data.raw_tickets(spark, d)).select("ticket_id", "difficulty")


@query
def g7_priority_stress(spark, d):
    return evalsets.priority_stress(data.raw_tickets(spark, d), SEED).select("ticket_id", "priority")


@query
def g8_review_simulation(spark, d):
    return evalsets.review_simulation(data.raw_tickets(spark, d), SEED).select("ticket_id")


@query
def g9_demo_set(spark, d):
    return evalsets.demo_set(data.raw_tickets(spark, d), SEED).select("ticket_id", "difficulty")


@query
def g10_chat_examples(spark, d):
    chat = evalsets.chat_examples(clean(spark, d))
    full = F.col("full_messages")
    return chat.select("ticket_id", F.array_join(full["role"], ",").alias("roles"),
                       F.array_join(full["content"], "\n").alias("contents"),
                       F.size("prompt_messages").cast("bigint").alias("prompt_length"))


# --- H. Evaluation ----------------------------------------------------------------------------


@query
def h1_accuracy(spark, d):
    return metrics.accuracy(predictions(spark, d))


@query
def h2_macro_scores(spark, d):
    scores = metrics.macro_scores(predictions(spark, d))
    # The order of a sum may change the last bits, so the comparison has eight places.
    return scores.select("task", *[round_half_up(F.col(c), 8).alias(c) for c in scores.columns if c != "task"])


@query
def h3_class_report(spark, d):
    return metrics.class_report(predictions(spark, d))


def _confusion(task):
    return lambda spark, d: metrics.confusion_matrix(predictions(spark, d), task)


for _task in metrics.TASKS:
    QUERIES[f"h4_confusion_{_task}"] = _confusion(_task)


@query
def h5_critical_failures(spark, d):
    return metrics.critical_failures(predictions(spark, d))


@query
def h6_validity_summary(spark, d):
    return metrics.validity_summary(predictions(spark, d))


@query
def h7_threshold_sweep(spark, d):
    return metrics.threshold_sweep(predictions(spark, d))


@query
def h8_recommended_threshold(spark, d):
    return metrics.recommended_threshold(metrics.threshold_sweep(predictions(spark, d)))


@query
def h9_final_label_evaluation(spark, d):
    return metrics.final_label_evaluation(triaged(spark, d))


@query
def h10_critical_escapes(spark, d):
    return metrics.critical_escapes(stored(triaged(spark, d), "triaged")).select("id", "final_priority")


@query
def h11_latency_profile(spark, d):
    return metrics.latency_profile(data.table(spark, d, "events"), "value")


# --- I. Plans ------------------------------------------------------------------------------------


def _plan(spark, d):
    keys = data.table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"))
    return scenario.scenario_plan(keys, SEED)


@query
def i1_scenario_plan(spark, d):
    return _plan(spark, d)


@query
def i2_plan_summary(spark, d):
    return scenario.plan_summary(_plan(spark, d))


@query
def i3_synthetic_customers(spark, d):
    rows = scenario.synthetic_customers(_plan(spark, d), SEED, data.as_of())
    return rows.select("plan_id", "customer_name", "contact_number", iso("timestamp"))


@query
def i4_topup_plan(spark, d):
    return scenario.topup_plan(scenario.shortfalls(quality.combinations(data.raw_tickets(spark, d))), SEED)


@query
def i5_prompts(spark, d):
    return scenario.prompts(_plan(spark, d)).select("plan_id", "system_prompt", "user_prompt")


@query
def i5_topup_prompts(spark, d):
    plan = scenario.topup_plan(scenario.shortfalls(quality.combinations(data.raw_tickets(spark, d))), SEED)
    return scenario.prompts(plan, topup=True).select("category", "priority", "department", "item", "user_prompt")


@query
def i6_manifest(spark, d):
    return scenario.manifest(_checked(spark, d).withColumn("accepted", F.col("valid")), "v1.0", BATCH_ID, SEED)
