"""Unique ids: streams of requests without ids, and appends that ask filters instead of the table."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import analytics, ingest, review, triage
from ticketloom.sources import id_filter, ticket_table

AS_OF = "2026-08-21 10:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def batch(spark, ids):
    rows = spark.createDataFrame([(i, "The network is down again", None, None, None) for i in ids],
                                 "ticket_id string, review string, customer_name string, contact_number string, timestamp string")
    return ingest.as_stored(triage.triage(rows), as_of())


def send(spark, folder, rows):
    spark.createDataFrame(rows, "ticket_id string, review string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, table, folder, state):
    requests = spark.readStream.schema("ticket_id string, review string").option("pathGlobFilter", "*.parquet").parquet(folder)
    ticket_table.stream_into(table, requests, "web", state, as_of()).awaitTermination()


def test_equal_requests_are_tickets_of_their_own(spark, tmp_path):
    table, folder = ticket_table.TicketTable(spark, str(tmp_path / "table")), str(tmp_path / "in")
    send(spark, folder, [(None, "Hello there"), (None, "Hello there"), (None, "no")])
    run(spark, table, folder, str(tmp_path / "state"))
    send(spark, folder, [(None, "Hello there")])
    run(spark, table, folder, str(tmp_path / "state"))
    ids = [r.ticket_id for r in table.state().collect()]
    assert len(ids) == 3 == len(set(ids)) and table.refused().isEmpty()
    assert all(i.startswith("TCK-20260821-WEB-") for i in ids)


def test_taken_ids_are_refused_and_the_stream_goes_on(spark, tmp_path):
    table, folder = ticket_table.TicketTable(spark, str(tmp_path / "table")), str(tmp_path / "in")
    send(spark, folder, [("A", "first of A"), ("A", "second of A"), ("B", "first of B")])
    run(spark, table, folder, str(tmp_path / "state"))
    send(spark, folder, [("B", "second of B"), ("C", "first of C"), ("", "without an id")])
    run(spark, table, folder, str(tmp_path / "state"))
    assert sorted(r.review for r in table.state().collect() if len(r.ticket_id) == 1) == ["first of A", "first of B", "first of C"]
    assert table.state().count() == 4 and sorted(r.review for r in table.refused().collect()) == ["second of A", "second of B"]
    # The same files under a lost checkpoint come as one micro-batch of a name that is there already.
    run(spark, table, folder, str(tmp_path / "other"))
    assert table.state().count() == 4 and table.refused().count() == 2


def test_append_reads_no_tickets_unless_a_filter_answers(spark, tmp_path, monkeypatch):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    for number in range(3):
        table.append_batch(batch(spark, [f"T-{i}" for i in range(number, 60, 4)]), f"b{number}")
    read, tickets = [], ticket_table.TicketTable.tickets

    def watched(self, *args, **options):
        read.append(options.get("batches"))
        return tickets(self, *args, **options)

    monkeypatch.setattr(ticket_table.TicketTable, "tickets", watched)
    table.append_batch(batch(spark, [f"T-{i}" for i in range(3, 60, 4)]), "b3")
    table.append_batch(batch(spark, ["Z-1"]), "b4")
    assert read == []
    with pytest.raises(ticket_table.DuplicateTickets, match="T-5"):
        table.append_batch(batch(spark, ["T-1000", "T-5"]), "b5")
    assert read == [["b1"]] and "b5" not in {r.batch for r in table.batches().collect()}
    assert table.state().count() == 61 and sorted(r.id for r in table.state().collect()) == list(range(1, 62))


@pytest.mark.parametrize("size", [1, 5000])
def test_filters_never_miss_an_id(spark, size):
    ids = spark.range(size).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("ticket_id"))
    filters = id_filter.build(ids, id_filter.size_for(size)).withColumn("batch", F.lit("x"))
    asked = ids.unionByName(spark.range(20_000).select(F.concat(F.lit("other-"), F.col("id").cast("string")).alias("ticket_id")))
    found = id_filter.answers(asked, filters)
    assert found.filter("ticket_id LIKE 'id-%'").count() == size
    assert found.filter("ticket_id LIKE 'other-%'").count() < 20


def test_broken_off_batch_is_written_again(spark, tmp_path, monkeypatch):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    rows = batch(spark, ["A", "B"])
    monkeypatch.setattr(id_filter, "build", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.append_batch(rows, "b1")
    assert table.state().isEmpty()
    monkeypatch.undo()
    table.append_batch(rows, "b1")
    assert sorted(r.ticket_id for r in table.state().collect()) == ["A", "B"]


def scattered(spark, first, count):
    """Tickets over some days, at whole hours, at edges of hours and between."""
    texts = ["The network is down again", "Please refund the wrong charge", "Medical emergency, the tower collapsed", "Hello there"]
    rows = [(f"T-{i}", texts[i % 4], f"2026-08-{1 + i * 7 % 28:02} {i * 5 % 24:02}:{(0, 0, 59, 17)[i % 4]:02}:{(0, 1, 59, 30)[i % 4]:02}")
            for i in range(first, first + count)]
    made = spark.createDataFrame([(a, b, None, None, None, c) for a, b, c in rows], "ticket_id string, review string, customer_name string, "
                                 "contact_number string, timestamp string, made string")
    return ingest.as_stored(triage.triage(made.withColumn("at", F.col("made").cast("timestamp_ntz"))), F.col("at"))


def test_trends_from_counts_equal_the_scan(spark, tmp_path):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    decision = lambda ids, when: spark.createDataFrame(
        [(i, "resolve", "Billing", "Low", "Finance", "n", when) for i in ids], review.DECISION_SCHEMA)
    table.append_batch(scattered(spark, 0, 150), "a")
    table.decide(decision(range(1, 40), datetime(2026, 9, 1)))
    table.append_batch(scattered(spark, 150, 100), "b")
    table.decide(decision([3, 3, 4, 180, 9999], datetime(2026, 9, 2)))
    table.decide(decision([3, 4], datetime(2026, 9, 2)))
    table.delete_pending(as_of())
    table._delete(spark.createDataFrame([(5,), (200,), (200,)], "id long"), as_of())
    state = table.state().cache()
    assert not [f for f in table.cube().inputFiles() if "/tickets/" in f]
    assert table.cube().agg(F.sum("tickets")).first()[0] == state.count() < 250
    rng = random.Random(6)
    for number in range(12):
        moment = datetime(2026, 8, rng.randint(1, 28), rng.randrange(24))
        if number % 2:
            moment = moment.replace(minute=rng.choice([0, 17, 59]), second=rng.choice([0, 30, 59]))
        days = rng.choice([1, 3, 7, 30])
        want = analytics.trends(state, F.lit(moment).cast("timestamp_ntz"), days).collect()
        assert sorted(table.trends(moment, days).collect()) == sorted(want)


def test_an_unfinished_decision_changes_no_count(spark, tmp_path):
    """The touched tickets are stored before the decision; without it they cancel out."""
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    table.append_batch(scattered(spark, 0, 20), "a")
    before = sorted(table.cube().collect(), key=str)
    table._touch(spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(table.cube().collect(), key=str) == before
