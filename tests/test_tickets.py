import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.functions import fixed
from ticketloom.functions.numbers import percent
from ticketloom.operators import (analytics, classifier, extract, ingest, metrics, ordering, quality, review, scenario,
                                  tickets, triage)
from ticketloom.plans import queries, tickets as data
from ticketloom.sources import csv_tickets, records, store, ticket_table
from ticketloom.streaming import tickets as streams

SF_DIR = "/root/testdata/sf0.001"
AS_OF = datetime(2026, 1, 2, 3, 4, 5)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_upload(spark, tmp_path):
    path = write(tmp_path / "u.csv", 'Text, Complaint ,Customer,Phone\n'
                 'ignored,"Line one\nline ""two"", end",Asha,981\n,  ,Ravi,\nx,nan,,5\nx,Slow net,,77\n')
    rows = csv_tickets.read_tickets_csv(spark, path).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == [1, 2, 3, 4]
    assert rows[0].review == 'Line one\nline "two", end' and rows[0].customer_name == "Asha"
    batch = ingest.ingest_batch(csv_tickets.read_tickets_csv(spark, path), "202601020304", as_of())
    got = {r.ticket_id: r for r in batch.collect()}
    assert set(got) == {"TCK-CSV-202601020304-0001", "TCK-CSV-202601020304-0004"}
    last = got["TCK-CSV-202601020304-0004"]
    assert (last.customer_name, last.contact_number, last.timestamp) == ("Customer #4", "77", "2026-01-02T03:04:05")
    summary = ingest.batch_summary(batch, "202601020304").first()
    assert summary.total_processed == 2 == summary.auto_routed_count + summary.human_review_count
    assert len(csv_tickets.preview(spark, path).collect()) == 4


@pytest.mark.parametrize("text", ["name,phone\na,b\n", "review,name\n", ""])
def test_csv_errors(spark, tmp_path, text):
    with pytest.raises(csv_tickets.UploadError):
        csv_tickets.read_tickets_csv(spark, write(tmp_path / "bad.csv", text))


def test_file_row_numbers_over_files(spark, tmp_path):
    for i in range(12):
        write(tmp_path / f"part{i:02d}.csv", "review\n" + "".join(f"r{i}_{j}\n" for j in range(i + 1)))
    rows = csv_tickets.read_tickets_csv(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [(r.row_number, r.review) for r in rows] == [
        (k + 1, name) for k, name in enumerate(f"r{i}_{j}" for i in range(12) for j in range(i + 1))]


def test_records_with_blank_and_broken_lines(spark, tmp_path):
    good = {"fields": {f: "x" for f in fixed.FIELDS}, "metadata": {"difficulty": "easy", "key_index": 2}}
    path = write(tmp_path / "r.jsonl", json.dumps(good) + "\n\n{broken\n" + json.dumps(good) + "\n")
    rows = records.read_records(spark, path).collect()
    assert len(rows) == 3 and sum(r._corrupt is not None for r in rows) == 1
    lines = records.read_record_lines(spark, path).collect()
    assert sorted(r.line_no for r in lines) == [1, 3, 4]


@pytest.mark.parametrize("change, reason", [
    ({}, ""), ({"category": "Other"}, "category: unknown value"), ({"review": "abcd"}, "review: too short"),
    ({"review": " None "}, "review: placeholder"), ({"review": 12345}, "review: string required"),
    ({"department": None}, "department: string required")])
def test_validation(spark, change, reason):
    fields = {f: "text here" for f in fixed.FIELDS} | {
        "category": "Billing", "priority": "Low", "department": "Finance"} | change
    df = spark.createDataFrame([(1, json.dumps({"fields": fields, "metadata": {}}))], "line_no int, line string")
    row = quality.validate_records(df).first()
    assert "; ".join(row.reasons) == reason and row.valid == (reason == "")


def test_single_triage(spark):
    row = ingest.triage_single(spark, {"review": " Tower collapsed, ambulance cannot reach us "}, "abcdef0", AS_OF).first()
    assert row.ticket_id == "TCK-20260102-ABCDEF0" and row.customer_name == "Anonymous Customer"
    assert row.routing_status == "HUMAN_REVIEW" and row.escalated
    for text in ("", "  ", "   ", "ab"):
        with pytest.raises(ingest.EmptyReview):
            ingest.triage_single(spark, {"review": text}, "abcdef", AS_OF)


def test_number_rows_and_running_total(spark):
    df = spark.range(0, 5000, 3).withColumn("w", F.col("id") % 5)
    got = ordering.number_rows(df.repartition(7), [F.desc("id")]).orderBy("row_number").collect()
    assert [(r.row_number, r.id) for r in got] == [(i + 1, x) for i, x in enumerate(range(4998, -1, -3))]
    total, expected = 0, {}
    for x in range(0, 5000, 3):
        total += x % 5
        expected[x] = total
    assert {r.id: r.t for r in ordering.running_total(df, "id", "w", "t").collect()} == expected


def test_deep_page_is_ranked_by_time_and_id(spark):
    now = queries.current_tickets(spark, SF_DIR)
    near = [r.id for r in tickets.page(now, 7, 30).collect()]
    ranked = sorted(((r.created_at, r.id) for r in now.select("created_at", "id").collect()), reverse=True)
    assert near == [number for _, number in ranked[180:210]]
    with pytest.raises(ValueError):
        tickets.page(now, 0, 30)


def test_decisions(spark):
    stored = queries.stored_tickets(spark, SF_DIR).filter("id between 1 and 4")
    rows = [(1, "resolve", "Billing", "Low", "Finance", None, datetime(2020, 1, 1)),
            (1, "override", "Refund", "High", "Refunds", "", datetime(2020, 1, 2)),
            (999_999, "resolve", "Billing", "Low", "Finance", None, datetime(2020, 1, 1))]
    decisions = spark.createDataFrame(rows, review.DECISION_SCHEMA)
    now = {r.id: r for r in review.apply_decisions(stored, decisions).collect()}
    assert now[1].final_category == "Refund" and now[1].routing_status == "RESOLVED"
    assert now[1].reviewer_notes == fixed.OVERRIDE_NOTE and now[1].updated_at == datetime(2020, 1, 2)
    assert not now[2].is_reviewed
    assert [r.id for r in review.unknown_tickets(decisions, stored).collect()] == [999_999]


def test_empty_table(spark):
    none = queries.stored_tickets(spark, SF_DIR).limit(0)
    row = analytics.summary(none).first()
    assert row.total_tickets == 0 and row.auto_routing_rate == 0.0 and row.avg_confidence == 0.0
    assert row.categories == {c: 0 for c in fixed.CATEGORIES}
    assert tickets.page_totals(none).first().total_pages == 1


@pytest.mark.parametrize("current, previous, change, way", [
    (0, 0, 0.0, "FLAT"), (5, 0, 100.0, "UP"), (0, 4, -100.0, "DOWN"), (3, 2, 50.0, "UP"),
    (2, 3, -33.3, "DOWN"), (10001, 10000, 0.0, "FLAT"), (1001, 1000, 0.1, "UP")])
def test_percentage_change(spark, current, previous, change, way):
    df = spark.createDataFrame([(current, previous)], "current bigint, previous bigint")
    row = analytics.with_change(df).first()
    assert (row.percentage_change, row.direction) == (change, way)


def test_percent_of_nothing(spark):
    assert spark.range(1).select(percent(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_recommended_threshold(spark):
    base = metrics.threshold_sweep(queries.predictions(spark, SF_DIR))
    none_safe = base.withColumn("critical_errors_auto_routed", F.lit(1))
    assert metrics.recommended_threshold(none_safe).first().threshold == 0.90
    all_safe = base.withColumns({"critical_errors_auto_routed": F.lit(0), "auto_routing_rate": F.lit(5.0)})
    assert metrics.recommended_threshold(all_safe).first().threshold == 0.70


def test_latency_profile_with_hot_value(spark):
    import numpy as np
    values = [1.0] * 500 + [float(i) / 7 for i in range(700)]
    row = metrics.latency_profile(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert row.samples == 1200 and row.mean_ms == pytest.approx(np.mean(values), abs=1e-5)
    for q, got in ((50, row.p50_ms), (95, row.p95_ms), (99, row.p99_ms)):
        assert got == pytest.approx(np.percentile(values, q))


def test_plan_shares(spark):
    plan = scenario.scenario_plan(scenario.plan_keys(spark, 20000), 42)
    n = plan.count()
    share = {r[0]: r[1] / n for r in plan.groupBy("category").count().collect()}
    assert all(abs(share[c] - w / 100) < 0.02 for c, w in fixed.CATEGORY_WEIGHTS.items())
    assert plan.filter("category = 'General' and priority = 'Critical'").isEmpty()
    assert quality.flag_departments(plan).filter("suspicious").isEmpty()
    assert sorted(plan.limit(0).columns) == sorted(scenario.scenario_plan(scenario.plan_keys(spark, 5), 1).columns)
    assert scenario.topup_plan(scenario.topup_targets(spark), 42).count() == 71


def test_topup_blocks(spark, monkeypatch):
    monkeypatch.setattr(scenario, "_BLOCK", 10)
    targets = spark.createDataFrame([("Billing", "Low", "Finance", 37), ("General", "Low", "Finance", 0)],
                                    "category string, priority string, department string, n bigint")
    assert sorted(r.item for r in scenario.topup_plan(targets, 1).collect()) == list(range(1, 38))


def test_store_window(spark, tmp_path):
    rows = queries.stored_tickets(spark, SF_DIR)
    path = str(tmp_path / "tickets")
    store.append_tickets(rows, path)
    since, until = datetime(2001, 7, 2), datetime(2001, 8, 1)
    got = store.read_tickets(spark, path, since, until)
    expected = rows.filter(F.col("created_at").between(F.lit(since), F.lit(until)))
    assert got.count() == expected.count() > 0
    assert "PartitionFilters: [isnotnull(created_month" in got._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    raw = data.raw_tickets(spark, SF_DIR)
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.filter("id < 700").repartition(4).write.mode("append").parquet(inbox)

    def run():
        source = streams.read_ticket_files(spark, inbox, raw.schema, files_per_batch=2)
        streams.triage_stream(source, out, state).awaitTermination()

    run()
    raw.filter("id >= 700").repartition(3).write.mode("append").parquet(inbox)
    run()
    batch = triage.triage(ingest.clean_reviews(raw))
    assert sorted(spark.read.parquet(out).collect(), key=lambda r: r.id) == sorted(batch.collect(), key=lambda r: r.id)

    live, live_state = str(tmp_path / "live"), str(tmp_path / "live_state")
    source = streams.read_ticket_files(spark, out, spark.read.parquet(out).schema, pattern="*.parquet", files_per_batch=3)
    streams.live_kpi_stream(source, live, live_state).awaitTermination()
    counts = streams.latest_counts(spark, live)
    kpis = streams.kpis_from_counts(counts).first().asDict()
    expected = analytics.kpi_counts(batch.withColumn("is_reviewed", F.lit(False))).first().asDict()
    assert kpis == expected


def test_classifier_learns(spark):
    rows = queries.clean(spark, SF_DIR).select("id", "review", "category", "priority", "department")
    scored = classifier.fit(rows).score(rows)
    right = scored.agg(F.avg((F.col("predicted_department") == F.col("department")).cast("int"))).first()[0]
    assert right > 0.8
    assert scored.filter("confidence < 0 or confidence > 1").isEmpty()


def test_lifecycle(spark, tmp_path):
    path = write(tmp_path / "day.csv", "customer_name,contact_number,review,timestamp\n"
                 "Anjali,981,Broadband dead since yesterday need urgent help,2026-08-21\n"
                 "Rajesh,982,Please reverse Rs 499 recharge deducted twice,2026-08-21\n"
                 "Meena,983,Medical emergency and the tower collapsed in sector 4,2026-08-21\n")
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    batch = ingest.ingest_batch(csv_tickets.read_tickets_csv(spark, path), "b1", as_of())
    table.append_batch(batch, "b1")
    table.append_batch(batch, "b1")
    with pytest.raises(ticket_table.DuplicateTickets):
        table.append_batch(batch, "b2")
    now = table.state()
    kpi = analytics.summary(now).first()
    assert kpi.total_tickets == 3 == kpi.auto_routed_count + kpi.human_review_count
    first = tickets.review_queue(now).first()
    assert first.customer_name == "Meena" and first.final_priority == "Critical"
    decision = spark.createDataFrame(
        [(first.id, "resolve", "Technical", "Critical", "Technical", "crew sent", AS_OF)], review.DECISION_SCHEMA)
    table.decide(decision)
    done = table.state()
    assert tickets.by_id(done, first.id).first().routing_status == "RESOLVED"
    assert analytics.summary(done).first().resolved_review_count == 1
    again = csv_tickets.read_tickets_csv(spark, write(tmp_path / "more.csv", "review\nThe tower collapsed, medical emergency\n"))
    table.append_batch(ingest.ingest_batch(again, "b3", as_of()), "b3")
    assert sorted(r.id for r in table.state().collect()) == [1, 2, 3, 4]
    table.pass_all(as_of())
    passed = tickets.by_id(table.state(), 4).first()
    assert passed.routing_status == "RESOLVED" and passed.reviewer_notes == fixed.PASS_ALL_NOTE
    assert tickets.by_id(table.state(), first.id).first().reviewer_notes == "crew sent"
    table.delete_pending(as_of())
    assert table.state().count() == 4
    assert table.state(since_month="2999-01").count() == 0
    table.delete_all(as_of())
    assert table.state().isEmpty() and table.tickets().count() == 4


def test_preview_shows_the_first_rows_by_file(spark, tmp_path):
    write(tmp_path / "a.csv", "review\na0\na1\n")
    write(tmp_path / "b.csv", "review\n" + "".join(f"b{i}\n" for i in range(200)))
    assert [r.review for r in csv_tickets.preview(spark, str(tmp_path)).collect()] == ["a0", "a1", "b0", "b1", "b2"]


def test_rows_without_an_id_are_one_group(spark):
    rows = spark.createDataFrame([(None, 3), (None, 2), ("a", 1), ("a", 0)], "ticket_id string, line_no int")
    assert sorted(map(tuple, quality.keep_first(rows).collect()), key=str) == [("a", 0), (None, 2)]


def test_long_numbers_and_gaps(spark):
    ids = ["TCK-5", "TCK-99999999999999999999", "TCK-000000000000002", "TCK-123456789012345", "x", None, "TCK-" + "9" * 39]
    df = spark.createDataFrame([(i,) for i in ids], "ticket_id string")
    totals = quality.sequence_totals(df).first()
    assert (int(totals.min_number), int(totals.max_number), int(totals.missing_count)) == (2, 10 ** 20 - 1, 10 ** 20 - 1 - 4)
    gaps = sorted((int(r.first_missing), int(r.last_missing)) for r in quality.sequence_gaps(df).collect())
    assert gaps == [(1, 1), (3, 4), (6, 123456789012344), (123456789012346, 10 ** 20 - 2)]
    assert quality.unreadable_numbers(df).count() == 1


def test_small_latencies_and_probabilities_are_not_cut(spark):
    row = metrics.latency_profile(spark.createDataFrame([(1e-7,), (3e-7,)], "v double"), "v").first()
    assert row.mean_ms == 2e-7 == row.p50_ms and row.throughput == 5e9
    outputs = spark.createDataFrame([(1, True)], "id long, valid boolean")
    tokens = spark.createDataFrame([(1, 0.123456789012), (1, 0.9)], "id long, p double")
    extract.confidence_by_output(outputs, tokens, "id", "p", "valid").collect()
    assert metrics.latency_profile(spark.createDataFrame([], "v double"), "v").first().samples in (0, None)


def test_repeated_headers(spark, tmp_path):
    path = write(tmp_path / "twice.csv", "Review,review,name,name\nfirst text,second text,Asha,Ravi\n")
    row = csv_tickets.read_tickets_csv(spark, path).first()
    assert (row.review, row.customer_name, row.row_number) == ("second text", "Asha", 1)
