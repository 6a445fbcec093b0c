"""Validation and reports on labelled records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import percent
from ..functions.text import strip
from .ordering import with_previous

# Numbers of ids: whole numbers of any length that Spark can hold.
NUMBER = "decimal(38,0)"

_LABELS = {"category": fixed.CATEGORIES, "priority": fixed.PRIORITIES, "department": fixed.DEPARTMENTS}


def validate_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse JSON lines and list what is wrong with each.

    Adds the eight fields, ``difficulty``, ``reasons`` (empty when valid) and ``valid``. A field
    must be a JSON string: a number is not accepted in its place.
    """
    df = lines.withColumn("_json", F.try_parse_json(F.col(line)))
    kind = {f: F.schema_of_variant(F.expr(f"try_variant_get(_json, '$.fields.{f}', 'variant')"))
            for f in fixed.FIELDS}
    df = df.withColumns({f"_kind_{f}": k for f, k in kind.items()})
    df = df.withColumns({
        f: F.when(F.col(f"_kind_{f}") == "STRING",
                  F.expr(f"try_variant_get(_json, '$.fields.{f}', 'string')"))
        for f in fixed.FIELDS})
    df = df.withColumn("difficulty", F.expr("try_variant_get(_json, '$.metadata.difficulty', 'string')"))
    parsed = F.col("_json").isNotNull()
    rules = [F.when(~parsed, "not json")]
    for f in fixed.FIELDS:
        rules.append(F.when(parsed & F.col(f).isNull(), F.lit(f"{f}: string required")))
    for f, labels in _LABELS.items():
        rules.append(F.when(~F.col(f).isin(labels), F.lit(f"{f}: unknown value")))
    rules.append(F.when(F.length("review") < fixed.REVIEW_MIN_LENGTH, F.lit("review: too short")))
    rules.append(F.when((F.length("review") >= fixed.REVIEW_MIN_LENGTH)
                        & F.lower(strip(F.col("review"))).isin(fixed.PLACEHOLDERS),
                        F.lit("review: placeholder")))
    df = df.withColumn("reasons", F.array_compact(F.array(*rules)))
    df = df.withColumn("valid", F.size("reasons") == 0)
    return df.select(*lines.columns, *fixed.FIELDS, "difficulty", "reasons", "valid")


def legitimate_department(category: Column, department: Column) -> Column:
    """Whether the department is the category's own or a listed other one."""
    allowed = {c: [d] + fixed.CROSS_DEPARTMENTS.get(c, []) for c, d in fixed.DEFAULT_DEPARTMENT.items()}
    answer = F.lit(False)
    for label, departments in allowed.items():
        answer = F.when(category == label, department.isin(departments)).otherwise(answer)
    return answer


def flag_departments(df: DataFrame) -> DataFrame:
    """Flag unusual category/department pairs. Flagged rows stay."""
    return df.withColumn("suspicious", ~legitimate_department(F.col("category"), F.col("department")))


def distribution(df: DataFrame, attributes: tuple[str, ...] = ("category", "priority", "department", "difficulty")) -> DataFrame:
    """Count and share of every value of every attribute, in one shuffle of partial counts."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    counts = df.select(F.inline(pairs)).groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy("attribute"))
    return counts.withColumn("percent", percent(F.col("tickets"), total))


def validation_totals(checked: DataFrame) -> DataFrame:
    """Loaded, valid, malformed and suspicious counts of validated, flagged rows."""
    return checked.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("malformed"),
        F.count_if(F.col("valid") & F.col("suspicious")).alias("suspicious"))


def exception_samples(checked: DataFrame, rows: int = 20, width: int = 150) -> DataFrame:
    """The first suspicious and the first malformed rows, with their reason cut to ``width``."""
    odd = checked.filter(F.col("valid") & F.col("suspicious")).select(
        F.lit("suspicious").alias("kind"), "line_no",
        F.concat_ws("", "ticket_id", F.lit(": "), "category", F.lit(" -> "), "department").alias("detail"))
    bad = checked.filter(~F.col("valid")).select(
        F.lit("malformed").alias("kind"), "line_no",
        F.substring(F.array_join("reasons", "; "), 1, width).alias("detail"))
    return odd.orderBy("line_no").limit(rows).unionByName(bad.orderBy("line_no").limit(rows))


def combinations(df: DataFrame) -> DataFrame:
    """Tickets per category, priority and department."""
    return df.groupBy("category", "priority", "department").agg(F.count(F.lit(1)).alias("tickets"))


def imbalance(df: DataFrame) -> DataFrame:
    """Spread of the combination counts: how many, smallest, largest, ratio and a warning."""
    counts = combinations(df).agg(
        F.count(F.lit(1)).alias("combinations"),
        F.min("tickets").alias("smallest"), F.max("tickets").alias("largest"))
    return counts.withColumn("ratio", F.col("largest") / F.col("smallest")).withColumn(
        "severe", F.col("ratio") > fixed.IMBALANCE_LIMIT)


def duplicate_ids(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Ids that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def id_totals(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Rows, distinct ids and repeated ids."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                      F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))


def trailing_number(ticket_id: Column) -> Column:
    """The number after the last hyphen of an id, null when there is none or it has over 38 digits."""
    return F.nullif(_digits(ticket_id), F.lit("")).try_cast(NUMBER)


def _digits(ticket_id: Column) -> Column:
    return F.regexp_extract(ticket_id, r"-0*(\d+)$", 1)


def _numbers(df: DataFrame, key: str) -> DataFrame:
    return df.select(trailing_number(F.col(key)).alias("n")).filter("n is not null")


def unreadable_numbers(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Ids whose number has more digits than the sequence reports can hold."""
    return df.filter(F.length(_digits(F.col(key))) > 38)


def sequence_totals(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Smallest and largest number and how many of 1..largest are missing."""
    distinct = _numbers(df, key).distinct()
    return distinct.agg(
        F.min("n").alias("min_number"), F.max("n").alias("max_number"),
        F.count_if(F.col("n") > 0).alias("_present")
    ).select("min_number", "max_number",
             (F.coalesce("max_number", F.lit(0).cast(NUMBER)) - F.col("_present")).cast(NUMBER).alias("missing_count"))


def sequence_gaps(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The gaps of 1..largest as ranges (``first_missing``, ``last_missing``).

    Each number is compared with the one before it, so the result is never longer than the input.
    """
    numbers = _numbers(df, key).filter("n > 0").distinct()
    before = F.coalesce("_before", F.lit(0).cast(NUMBER))
    return with_previous(numbers, "n", "_before").filter(F.col("n") > before + 1).select(
        (before + 1).cast(NUMBER).alias("first_missing"), (F.col("n") - 1).cast(NUMBER).alias("last_missing"))


def keep_first(df: DataFrame, key: str = "ticket_id", order: str = "line_no") -> DataFrame:
    """The first row of each id; rows without an id are one group.

    Only the first place per id is aggregated, with partial minima before the shuffle, so a hot
    id does not gather its rows in one task.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_first")), "left_semi")


def progress(df: DataFrame, key: str = "ticket_id", batch: str = "generation_batch",
             order: str = "line_no") -> DataFrame:
    """Resume point of a generation run: highest number, rows so far, batch of the last row."""
    return df.agg(
        F.coalesce(F.max(trailing_number(F.col(key))), F.lit(0).cast(NUMBER)).alias("next_index"),
        F.count(F.lit(1)).alias("accepted"),
        F.lit(0).cast("bigint").alias("rejected"),
        F.max_by(batch, order).alias("batch_id"))


def missing_fields(df: DataFrame) -> DataFrame:
    """Add the names of the required fields that are null or empty."""
    empty = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f) for f in fixed.FIELDS]
    return df.withColumn("missing", F.array_compact(F.array(*empty)))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with all eight fields."""
    return missing_fields(df).filter(F.size("missing") == 0).drop("missing")
