"""Reproducible draws: hashes of a key and a seed, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DRAW_RANGE = 1 << 32


def digest(key: Column, seed: int, stream: str = "") -> Column:
    """Hex digest of key, seed and a stream name. One digest holds four draws."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{stream}")))


def draw(hex_digest: Column, slot: int) -> Column:
    """32-bit draw number ``slot`` (0 to 3) of a digest."""
    return F.conv(F.substring(hex_digest, 8 * slot + 1, 8), 16, 10).cast("bigint")


def below_percent(number: Column, percent: int) -> Column:
    return number * 100 < F.lit(percent * _DRAW_RANGE)


def uniform_index(number: Column, size: Column | int) -> Column:
    """0-based index, uniform over ``size`` entries."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.shiftright(number * size.cast("bigint"), 32).cast("int")


def pick(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), uniform_index(number, len(values)) + 1)


def weighted(number: Column, weights: dict[str, int]) -> Column:
    """Label chosen by integer percent weights."""
    items = [(label, weight) for label, weight in weights.items() if weight > 0]
    upper, choice = 0, None
    for label, weight in items[:-1]:
        upper += weight
        hit = below_percent(number, upper)
        choice = F.when(hit, label) if choice is None else choice.when(hit, label)
    last = F.lit(items[-1][0])
    return last if choice is None else choice.otherwise(last)


def by_label(label: Column, branches: dict[str, Column]) -> Column:
    choice = None
    for value, result in branches.items():
        choice = F.when(label == value, result) if choice is None else choice.when(label == value, result)
    return choice
