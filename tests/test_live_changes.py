"""Changes of the live counts from the rows that micro-batches keep for a ticket."""

from ticketloom.streaming import reviews

AUTO = ("AUTO_ROUTED", "Billing", "Low", "Finance", False)


def test_changes_fold_the_batches_before(spark):
    late = ("2026-09-02", "resolve", "Refund", "High", "Refunds")
    known = spark.createDataFrame([(1, AUTO, None, False, 0), (2, None, late, False, 0), (9, AUTO, None, False, 0)], reviews._KEPT)
    kept = spark.createDataFrame([(1, None, late, False, 1), (2, AUTO, None, False, 1), (3, AUTO, None, True, 1)], reviews._KEPT)
    resolved = ("RESOLVED", "Refund", "High", "Refunds", True)
    assert {tuple(r) for r in reviews.group_changes(kept, known, 1).collect()} == {(*AUTO, -1), (*resolved, 2)}
