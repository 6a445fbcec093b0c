"""Dashboard numbers. Each report is one scan with one partial and one final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import direction, mean_of_scaled, percent, percentage_change

LABEL_GROUPS = {
    "category": ("final_category", fixed.CATEGORIES),
    "priority": ("final_priority", fixed.PRIORITIES),
    "department": ("final_department", fixed.DEPARTMENTS),
}


def _is_pending() -> Column:
    return (F.col("routing_status") == "HUMAN_REVIEW") & ~F.col("is_reviewed")


def status_conditions() -> dict[str, Column]:
    return {
        "total_tickets": F.lit(True),
        "auto_routed_count": F.col("routing_status") == "AUTO_ROUTED",
        "human_review_count": _is_pending(),
        "resolved_review_count": (F.col("routing_status") == "RESOLVED") | F.col("is_reviewed"),
    }


def status_counts() -> dict[str, Column]:
    return {name: F.count_if(condition) for name, condition in status_conditions().items()}


def _confidence_sum() -> Column:
    """Sum of confidences in ten-thousandths: whole numbers add up alike in any order."""
    return F.sum(F.round(F.col("confidence") * 10000).cast("bigint"))


def kpi_counts(tickets: DataFrame, weight: str | None = None) -> DataFrame:
    """The status counts as one row. A row counts ``weight`` times, if a column is named."""
    if weight is None:
        return tickets.agg(*[c.alias(n) for n, c in status_counts().items()])
    return tickets.agg(*[F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("bigint").alias(n) for n, c in status_conditions().items()])


def routing_rate(tickets: DataFrame) -> DataFrame:
    return kpi_counts(tickets).select(
        percent(F.col("auto_routed_count"), F.col("total_tickets")).alias("auto_routing_rate"))


def average_confidence(tickets: DataFrame) -> DataFrame:
    sums = tickets.agg(F.count(F.lit(1)).alias("n"), _confidence_sum().alias("s"))
    return sums.select(mean_of_scaled(F.coalesce("s", F.lit(0)), F.col("n"), 10000, 3).alias("avg_confidence"))


def _label_counts(group: str) -> dict[str, Column]:
    column, labels = LABEL_GROUPS[group]
    return {label: F.count_if(F.col(column) == label) for label in labels}


def _as_rows(wide: DataFrame, names: list[str], columns: list[list[Column]], into: list[str]) -> DataFrame:
    """One aggregated row to one row per name."""
    entries = [F.struct(F.lit(name).alias("name"), *[c.alias(i) for c, i in zip(cells, into)])
               for name, cells in zip(names, columns)]
    return wide.select(F.inline(F.array(*entries)))


def breakdown(tickets: DataFrame, group: str) -> DataFrame:
    """Tickets per label of one group: every known label, also at zero; other values dropped."""
    labels = LABEL_GROUPS[group][1]
    wide = tickets.agg(*[c.alias(f"c{i}") for i, c in enumerate(_label_counts(group).values())])
    return _as_rows(wide, labels, [[F.col(f"c{i}")] for i in range(len(labels))], ["tickets"])


def summary(tickets: DataFrame) -> DataFrame:
    """The whole dashboard summary as one row, from one scan. All zeros on an empty table."""
    measures = {**status_counts(), "_confidence": _confidence_sum()}
    for group in LABEL_GROUPS:
        measures |= {f"{group}_{label}": c for label, c in _label_counts(group).items()}
    wide = tickets.agg(*[c.alias(n) for n, c in measures.items()])
    shown = [F.col(n) for n in status_counts()]
    shown += [
        percent(F.col("auto_routed_count"), F.col("total_tickets")).alias("auto_routing_rate"),
        mean_of_scaled(F.coalesce("_confidence", F.lit(0)), F.col("total_tickets"), 10000, 3)
        .alias("avg_confidence"),
    ]
    shown += [F.col(f"priority_{p}").alias(f"{p.lower()}_count") for p in fixed.PRIORITIES]
    for group, plural in (("category", "categories"), ("priority", "priorities"),
                          ("department", "departments")):
        cells = [x for label in LABEL_GROUPS[group][1]
                 for x in (F.lit(label), F.col(f"`{group}_{label}`"))]
        shown.append(F.create_map(*cells).alias(plural))
    return wide.select(*shown)


def summary_flat(tickets: DataFrame) -> DataFrame:
    """``summary`` with the three maps spread to one column per label."""
    one = summary(tickets)
    spread = [F.col(c) for c in one.columns if c not in ("categories", "priorities", "departments")]
    for group, plural in (("category", "categories"), ("department", "departments")):
        spread += [F.col(plural)[label].alias(f"{group}_{label.lower().replace(' ', '_')}")
                   for label in LABEL_GROUPS[group][1]]
    return one.select(*spread)


def _windows(as_of: Column, days: int, moment: str) -> tuple[Column, Column, Column]:
    """Conditions: in the current window, in the one before, in either."""
    if not 1 <= days <= 30:
        raise ValueError("the window is 1 to 30 days")
    at, width = F.col(moment), F.make_dt_interval(F.lit(days))
    start, before = as_of - width, as_of - width - width
    current = (at >= start) & (at <= as_of)
    previous = (at >= before) & (at < start)
    return current, previous, (at >= before) & (at <= as_of)


def _trend_items(df: DataFrame, items: dict[str, Column], as_of: Column, days: int,
                 moment: str, weight: str | None = None) -> DataFrame:
    """Count each item in both windows in one scan of the two windows. A row counts ``weight`` times."""
    def tally(condition: Column) -> Column:
        if weight is None:
            return F.count_if(condition)
        return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("bigint")

    current, previous, either = _windows(as_of, days, moment)
    measures = []
    for i, condition in enumerate(items.values()):
        measures += [tally(current & condition).alias(f"cur{i}"), tally(previous & condition).alias(f"prev{i}")]
    wide = df.filter(either).agg(*measures)
    cells = [[F.col(f"cur{i}"), F.col(f"prev{i}")] for i in range(len(items))]
    rows = _as_rows(wide, list(items), cells, ["current", "previous"])
    return with_change(rows)


def with_change(rows: DataFrame) -> DataFrame:
    """Add percentage change and direction to rows with current and previous."""
    return rows.withColumn(
        "percentage_change", percentage_change(F.col("current"), F.col("previous"))
    ).withColumn("direction", direction(F.col("percentage_change")))


def summary_trends(tickets: DataFrame, as_of: Column, days: int = 7,
                   moment: str = "created_at") -> DataFrame:
    """Volume, auto-routed and review-queue trends. The queue counts the status alone here."""
    return _trend_items(tickets, {
        "Total Volume": F.lit(True),
        "Auto-Routed": F.col("routing_status") == "AUTO_ROUTED",
        "Review Queue": F.col("routing_status") == "HUMAN_REVIEW",
    }, as_of, days, moment)


def label_trends(df: DataFrame, column: str, labels: list[str], as_of: Column, days: int = 7,
                 moment: str = "created_at") -> DataFrame:
    """Trend of each label of a column."""
    return _trend_items(df, {label: F.col(column) == label for label in labels}, as_of, days, moment)


def trends(tickets: DataFrame, as_of: Column, days: int = 7, weight: str | None = None) -> DataFrame:
    """All 17 trend items with their group, from one scan; ``weight`` names a column of counts."""
    items = {
        ("summary", "Total Volume"): F.lit(True),
        ("summary", "Auto-Routed"): F.col("routing_status") == "AUTO_ROUTED",
        ("summary", "Review Queue"): F.col("routing_status") == "HUMAN_REVIEW",
    }
    for group, (column, labels) in LABEL_GROUPS.items():
        items |= {(group, label): F.col(column) == label for label in labels}
    named = {f"{group}|{name}": condition for (group, name), condition in items.items()}
    rows = _trend_items(tickets, named, as_of, days, "created_at", weight)
    parts = F.split("name", r"\|")
    return rows.withColumn("group", parts[0]).withColumn("name", parts[1])
