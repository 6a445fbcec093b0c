"""Scoring, safety rules and routing. Every step is a projection: no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..functions.text import any_of, fold_case, is_ascii, matches

OUTPUT = ["predicted_category", "predicted_priority", "predicted_department", "confidence",
          "final_category", "final_priority", "final_department", "routing_status", "escalated",
          "escalation_reason", "raw_output", "is_valid_json", "model_version"]


def with_text_views(df: DataFrame, text: str = "review") -> DataFrame:
    """Add the forms of the text that the rules read, and what one pass over a batch finds in them.

    Kept as projections of their own: Spark does not merge projections whose result is used more
    than once, so each form is computed once per row.
    """
    column = F.col(text)
    return df.withColumns({"_ascii": is_ascii(column), "_lower": F.lower(column)}).withColumn(
        "_folded", F.when(F.col("_ascii"), F.col("_lower")).otherwise(fold_case(column)),
    ).withColumns({"_signs": scoring.signs(F.col("_folded")), "_words": scoring.vocabulary(F.col("_lower"))})


def with_keyword_labels(df: DataFrame, text: str = "review") -> DataFrame:
    """Add the predicted labels and the number of keywords behind them."""
    found = {"_category": fixed.CATEGORY_RULES, "_priority": fixed.PRIORITY_RULES}
    df = with_text_views(df, text).withColumns({
        name: scoring.first_list_with_hits("_lower", rules) for name, rules in found.items()})
    category = scoring.found_label(F.col("_category"), fixed.CATEGORY_RULES, fixed.CATEGORY_ELSE)
    return df.withColumns({
        "predicted_category": category,
        "predicted_priority": scoring.found_label(
            F.col("_priority"), fixed.PRIORITY_RULES, fixed.PRIORITY_ELSE),
        "matched_keywords": scoring.found_hits(F.col("_category")) + scoring.found_hits(F.col("_priority")),
    }).withColumn(
        "predicted_department", scoring.default_department(F.col("predicted_category"))
    ).drop(*found)


def _terms(text: str) -> dict[str, Column]:
    return scoring.confidence_terms(
        F.col(text), F.col("_folded"), F.col("_ascii"), F.col("_signs"), F.col("_words"),
        F.col("predicted_priority"), F.col("matched_keywords"))


def with_confidence(df: DataFrame, text: str = "review") -> DataFrame:
    """Add the confidence score; needs the columns of ``with_keyword_labels``."""
    total = reduce(lambda a, b: a + b, _terms(text).values())
    return df.withColumn("confidence", scoring.clamp_confidence(total))


def with_confidence_terms(df: DataFrame, text: str = "review") -> DataFrame:
    """Add each addend of the confidence as its own column ``term_*``."""
    return df.withColumns({f"term_{name}": column for name, column in _terms(text).items()})


def escalation_reason(folded: Column, ascii_only: Column, signs: Column) -> Column:
    """Reason of the first critical rule that matches, else null. ``signs`` has its number for an ASCII text.

    One combined search settles the common case, a ticket that no rule matches.
    """
    rules = fixed.CRITICAL_RULES
    reason = None
    for pattern, text in rules:
        hit = matches(folded, pattern)
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    reasons = F.array(F.lit(None).cast("string"), *[F.lit(text) for _, text in rules])
    return F.when(ascii_only, F.element_at(reasons, signs["rule"] + 1)).otherwise(
        F.when(matches(folded, any_of([p for p, _ in rules])), reason))


def needs_high(folded: Column, ascii_only: Column, signs: Column) -> Column:
    return F.when(ascii_only, signs["high"]).otherwise(matches(folded, any_of(fixed.HIGH_RULES)))


def corrected_department(category: Column, department: Column) -> Column:
    fix = None
    for label, wrong, right in fixed.DEPARTMENT_FIXES:
        hit = (category == label) & department.isin(wrong)
        fix = F.when(hit, right) if fix is None else fix.when(hit, right)
    return fix.otherwise(department)


def routing_status(escalated: Column, priority: Column, confidence: Column, threshold: float) -> Column:
    review = (
        escalated
        | (confidence < F.lit(threshold))
        | ((priority == "Critical") & (confidence < F.lit(fixed.CRITICAL_CONFIDENCE)))
    )
    return F.when(review, "HUMAN_REVIEW").otherwise("AUTO_ROUTED")


def with_safety(df: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add final labels, escalation and routing to rows with predicted labels and confidence.

    Needs the columns of ``with_text_views``.
    """
    views, predicted = [F.col(c) for c in ("_folded", "_ascii", "_signs")], F.col("predicted_priority")
    raised = ~predicted.isin("High", "Critical") & needs_high(*views)
    df = df.withColumn("escalation_reason", escalation_reason(*views))
    df = df.withColumns({
        "escalated": F.col("escalation_reason").isNotNull(),
        "final_category": F.col("predicted_category"),
        "final_priority": F.when(F.col("escalation_reason").isNotNull(), "Critical")
        .when(raised, "High").otherwise(predicted),
        "final_department": corrected_department(F.col("predicted_category"),
                                                 F.col("predicted_department")),
        "confidence_passed": F.col("confidence") >= F.lit(threshold),
    })
    return df.withColumn("routing_status", routing_status(
        F.col("escalated"), F.col("final_priority"), F.col("confidence"), threshold))


def triage(df: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD, text: str = "review",
           model_version: str = fixed.MODEL_VERSION) -> DataFrame:
    """Full triage: the input columns plus the thirteen output fields.

    Store the result before filtering on an output field. Spark would otherwise move the filter
    below the projections and evaluate the rules a second time for it.
    """
    scored = with_safety(with_confidence(with_keyword_labels(df, text), text), threshold)
    labels = F.concat(
        F.lit('{"category": "'), "predicted_category",
        F.lit('", "priority": "'), "predicted_priority",
        F.lit('", "department": "'), "predicted_department", F.lit('"}'))
    return scored.withColumns({
        "raw_output": labels,
        "is_valid_json": F.lit(True),
        "model_version": F.lit(model_version),
    }).select(*df.columns, *OUTPUT)


def rescore(tickets: DataFrame, as_of: Column, text: str = "review") -> DataFrame:
    """Replace the confidence and stamp ``updated_at``; labels and routing stay as they are."""
    keep = tickets.select(
        "*", F.struct(*[F.col(c) for c in tickets.columns]).alias("_row")).select("_row", text)
    scored = with_confidence(with_keyword_labels(keep, text), text)
    return scored.select(*[
        F.col("confidence") if c == "confidence"
        else as_of.alias(c) if c == "updated_at" else F.col(f"_row.{c}").alias(c)
        for c in tickets.columns])
