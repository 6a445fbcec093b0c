"""Snapshots that no reader notices, and live counts that follow reviews."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_ticket_table import as_of, scattered
from ticketloom.operators import analytics, review
from ticketloom.sources import ticket_table
from ticketloom.streaming import reviews, tickets as streams


def decisions(spark, rows):
    return spark.createDataFrame([(i, kind, "Billing", priority, "Finance", note, when) for i, kind, priority, note, when in rows],
                                 review.DECISION_SCHEMA)


def history(spark, table, compact):
    """Decisions before their tickets, late ones of earlier times, repeats, deletions; ``compact`` after each step."""
    day = lambda n: datetime(2026, 9, n)
    compact()
    table.append_batch(scattered(spark, 0, 60), "a")
    compact()
    table.decide(decisions(spark, [(1, "override", "Low", None, day(5)), (2, "resolve", "High", "x", day(5)), (70, "resolve", "Low", "early", day(1))]))
    compact()
    table.decide(decisions(spark, [(1, "resolve", "High", "older", day(4)), (2, "resolve", "High", "y", day(5)), (3, "resolve", None, None, day(2)),
                                   (9999, "resolve", "Low", "unknown", day(2))]))
    table._delete(spark.createDataFrame([(4,), (75,)], "id long"), as_of())
    table.append_batch(scattered(spark, 60, 30), "b")
    compact()
    table.delete_pending(as_of())
    table.decide(decisions(spark, [(4, "resolve", "Low", "deleted", day(9)), (80, "override", "Low", "", day(3))]))
    compact()
    compact()
    table.append_batch(scattered(spark, 90, 5), "c")


def rows_of(table):
    return sorted(table.state().collect(), key=lambda r: r.id)


def test_compaction_is_invisible(spark, tmp_path):
    plain, steps = [ticket_table.TicketTable(spark, str(tmp_path / name)) for name in ("plain", "steps")]
    history(spark, plain, lambda: None)
    seen = []

    history(spark, steps, lambda: seen.append(steps.compact(buckets=3)))
    assert seen == [1, 2, 3, 4, 5, 6]
    want = rows_of(plain)
    assert rows_of(steps) == want and len(want) > 40
    assert plain.compact() == 1 and rows_of(plain) == want
    assert {r.id: r.reviewer_notes for r in want if r.id in (2, 70, 9999)} == {2: "y", 70: "early"}
    assert want[0].final_priority == "Low" and 4 not in {r.id for r in want} and 75 not in {r.id for r in want}
    assert sorted(steps.trends(datetime(2026, 8, 20), 7).collect()) == sorted(plain.trends(datetime(2026, 8, 20), 7).collect())


def test_a_broken_off_compaction_is_replaced(spark, tmp_path, monkeypatch):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    table.append_batch(scattered(spark, 0, 20), "a")
    before = rows_of(table)
    write = ticket_table.snapshot.write

    def breaks(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(ticket_table.snapshot, "write", breaks)
    with pytest.raises(RuntimeError):
        table.compact(2)
    monkeypatch.undo()
    assert rows_of(table) == before
    table.decide(decisions(spark, [(1, "resolve", "Low", "n", datetime(2026, 9, 1))]))
    after = rows_of(table)
    assert table.compact(2) == 1 and rows_of(table) == after != before


def nodes(df):
    """(depth, text) of the nodes of a physical plan before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-")) for line in lines]


def test_snapshot_rows_are_not_shuffled(spark, tmp_path):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    table.append_batch(scattered(spark, 0, 40), "a")
    table.compact(16)
    table.decide(decisions(spark, [(i, "resolve", "Low", "n", datetime(2026, 9, 1)) for i in range(1, 9)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nodes(table.state())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, (_, text) in enumerate(plan) if "FileScan" in text and "last_decision" in text)
    depth, above = plan[at][0], []
    for level, text in reversed(plan[:at]):
        if level < depth:
            depth = level
            above.append(text)
    assert any("SortMergeJoin" in text for text in above) and not any("Exchange" in text for text in above)
    assert "Bucketed: true" in plan[at][1]
    one = next(text for _, text in nodes(table.state().filter("id = 7")) if "FileScan" in text and "last_decision" in text)
    assert "SelectedBucketsCount: 1 out of 16" in one and "EqualTo(id,7)" in one
    named = next(text for _, text in nodes(table.state().filter("ticket_id = 'T-7'")) if "FileScan" in text and "last_decision" in text)
    assert "EqualTo(ticket_id,T-7)" in named


def test_live_counts_follow_reviews_in_any_order(spark, tmp_path):
    """Events of each kind come in files dealt at random, so that decisions and deletions may precede their tickets."""
    rng = random.Random(3)
    moment = lambda: datetime(2026, 9, rng.randint(1, 3))
    uploads = scattered(spark, 0, 80).withColumn("id", F.substring("ticket_id", 3, 9).cast("long")).select("id", *reviews.GROUP)
    decided = [(rng.randrange(90), rng.choice(["resolve", "override"]), rng.choice(["Low", "High", None]), None, moment()) for _ in range(60)]
    deleted = [(rng.randrange(90),) for _ in range(15)] + [(None,)]
    tables = {"uploads": uploads, "decisions": decisions(spark, decided + decided[:5]), "deletions": spark.createDataFrame(deleted, "id long")}
    arriving = {}
    for name, rows in tables.items():
        for part in range(4):
            picked = rows.filter(F.pmod(F.hash("id", F.lit(name)), F.lit(4)) == part)
            picked.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        arriving[name] = streams.read_ticket_files(spark, str(tmp_path / name), rows.schema, "*.parquet", files_per_batch=1)
    stream = reviews.review_events(arriving["uploads"], arriving["decisions"], arriving["deletions"])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    reviews.live_review_stream(stream, out, state).awaitTermination()
    blank = {"reviewer_notes": "string", "reviewed_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
    now = review.apply_decisions(review.without_deleted(uploads, tables["deletions"]).withColumns(
        {name: F.lit(None).cast(kind) for name, kind in blank.items()}), tables["decisions"])
    counts = reviews.latest_review_counts(spark, out)
    assert sorted(counts.collect(), key=str) == sorted(now.groupBy(*reviews.GROUP).agg(F.count(F.lit(1)).alias("tickets")).collect(), key=str)
    assert reviews.kpis_from_review_counts(counts).first() == analytics.kpi_counts(now).first()
    # Every ticket deleted: nothing is left to count.
    spark.range(90).coalesce(1).write.mode("append").parquet(str(tmp_path / "deletions"))
    reviews.live_review_stream(stream, out, state).awaitTermination()
    assert reviews.latest_review_counts(spark, out).isEmpty()
    assert reviews.kpis_from_review_counts(reviews.latest_review_counts(spark, out)).first().total_tickets == 0
