"""Rounding and rates that give the same value in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double with plain IEEE steps only."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole from counts, rounded half up; 0.0 when whole is 0."""
    scale = 10 ** digits
    part, whole = part.cast("bigint"), whole.cast("bigint")
    doubled = (part * F.lit(200 * scale) + whole)
    rounded = (doubled - doubled % (whole * 2)) / (whole * 2)
    return F.when(whole == 0, F.lit(0.0)).otherwise(rounded / F.lit(float(scale)))


def mean_of_scaled(total: Column, count: Column, scale: int, digits: int) -> Column:
    """Mean of values stored as integers times ``scale``, rounded to ``digits``; 0.0 when empty."""
    step = scale // 10 ** digits
    count = count.cast("bigint")
    doubled = total.cast("bigint") * 2 + count * step
    width = count * (2 * step)
    rounded = (doubled - doubled % width) / width
    return F.when(count == 0, F.lit(0.0)).otherwise(rounded / F.lit(float(10 ** digits)))


def percentage_change(current: Column, previous: Column) -> Column:
    """Relative change in percent, one decimal; a zero base gives 0.0 or 100.0."""
    delta = (current - previous).cast("bigint")
    size = percent(F.abs(delta), previous)
    return (
        F.when(previous != 0, F.when(delta < 0, F.lit(0.0) - size).otherwise(size))
        .when(current == 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )


def direction(change: Column) -> Column:
    return F.when(change > 0, F.lit("UP")).when(change < 0, F.lit("DOWN")).otherwise(F.lit("FLAT"))
