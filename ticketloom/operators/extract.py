"""Labels from raw model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import calibrated
from ..functions.text import strip

_DEFAULTS = {"category": "General", "priority": "Medium", "department": "General Support"}
_STRICT_JSON = {"allowSingleQuotes": "false"}


def _json_object(text: Column) -> Column:
    """The object as a string map, null when the text does not start with one."""
    return F.from_json(text, "map<string,string>", _STRICT_JSON)


def extract_labels(df: DataFrame, output: str = "raw_output") -> DataFrame:
    """Add category, priority, department and raw_valid parsed from ``output``.

    Strips code fences, reads the object at the first brace, then falls back to the first flat
    ``{...}``. A missing key takes its default, and so does everything when nothing parses.
    """
    text = strip(F.coalesce(F.col(output), F.lit("")))
    text = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    text = F.regexp_replace(text, r"\s*```$", "")
    df = df.withColumn("_clean", text)
    first = F.when(F.instr("_clean", "{") > 0, F.expr("substr(_clean, instr(_clean, '{'))"))
    flat = F.regexp_extract("_clean", r"(\{[^{}]*\})", 1)
    df = df.withColumns({"_first": _json_object(first), "_flat": _json_object(flat)})
    df = df.withColumn("_labels", F.coalesce("_first", "_flat")).drop("_clean", "_first", "_flat")
    valid = F.col("_labels").isNotNull()
    fields = {
        key: F.when(valid & F.map_contains_key("_labels", F.lit(key)),
                    strip(F.coalesce(F.col("_labels")[key], F.lit("None"))))
        .otherwise(F.lit(default))
        for key, default in _DEFAULTS.items()
    }
    return df.withColumns({**fields, "raw_valid": valid}).drop("_labels")


def confidence_by_output(outputs: DataFrame, probabilities: DataFrame, key: str,
                         probability: str, valid: str) -> DataFrame:
    """Confidence of each output from a long table of its token probabilities.

    Only mean and minimum are kept per output, in partial aggregates, so an output with very many
    tokens is not gathered anywhere. Sums are decimal and do not depend on order; their 18 places
    are more than a double holds near 1.
    """
    exact = F.col(probability).cast("decimal(38,18)")
    stats = probabilities.groupBy(key).agg(
        (F.sum(exact).cast("double") / F.count(exact)).alias("_mean"), F.min(probability).alias("_low"))
    joined = outputs.join(stats, key, "left")
    return joined.withColumn("confidence", calibrated(
        F.coalesce("_mean", F.lit(1.0)), F.coalesce("_low", F.lit(1.0)), F.col(valid))
    ).drop("_mean", "_low")
