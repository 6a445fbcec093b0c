"""Keyword labels and the confidence score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches, fixed
from .numbers import round_half_up
from .text import any_of, matches

_TWO_POW_64_MOD = (1 << 64) % fixed.JITTER_MODULUS


# Above the number of lists in a rule set; holds "hits" and "which list" in one integer.
_RANKS = 16


def first_list_with_hits(lowered: str, rules: list[tuple[str, list[str]]]) -> Column:
    """``hits * 16 + list number`` of the first list with a hit; below 16 when none has one. ``lowered`` names a column."""
    found = batches.first_list([words for _, words in rules], _RANKS)
    return F.arrow_udf(found, "int")(F.col(lowered))


def found_label(found: Column, rules: list[tuple[str, list[str]]], fallback: str) -> Column:
    labels = F.array(*[F.lit(label) for label, _ in rules])
    return F.when(found >= _RANKS, F.element_at(labels, found % _RANKS + 1)).otherwise(F.lit(fallback))


def found_hits(found: Column) -> Column:
    return F.shiftright(found, _RANKS.bit_length() - 1)


def default_department(category: Column) -> Column:
    rules = fixed.DEFAULT_DEPARTMENT
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), category)


def priority_base(priority: Column) -> Column:
    base = None
    for label, value in fixed.PRIORITY_BASE.items():
        base = F.when(priority == label, value) if base is None else base.when(priority == label, value)
    return base.otherwise(F.lit(fixed.PRIORITY_BASE["Medium"]))


def hit_term(hits: Column) -> Column:
    return F.least(hits * F.lit(fixed.PER_HIT), F.lit(fixed.HIT_LIMIT))


def length_term(text: Column) -> Column:
    size, low, high = F.length(text), *fixed.LENGTH_IDEAL
    terms = fixed.LENGTH_TERMS
    return (
        F.when(size < fixed.LENGTH_VERY_SHORT, terms["very_short"])
        .when(size < fixed.LENGTH_SHORT, terms["short"])
        .when(size > fixed.LENGTH_LONG, terms["long"])
        .when(size.between(low, high), terms["ideal"])
        .otherwise(F.lit(0.0))
    )


def signs(folded: Column) -> Column:
    """What the rules find in a case-folded ASCII text: ``signals``, ``rule`` (the first critical one, from 1) and ``high``."""
    critical = [pattern for pattern, _ in fixed.CRITICAL_RULES]
    of = batches.signs(fixed.SIGNAL_PATTERNS, critical, any_of(critical), any_of(fixed.HIGH_RULES))
    return F.arrow_udf(of, "signals int, rule int, high boolean")(folded)


def vocabulary(lowered: Column) -> Column:
    """``total`` and ``distinct`` words, cut at white space of every kind."""
    return F.arrow_udf(batches.vocabulary, "total int, distinct int")(lowered)


def signal_count(folded: Column, ascii_only: Column, found: Column) -> Column:
    """How many of the six signals the text shows. ``found`` are its ``signs``."""
    total = F.lit(0)
    for pattern in fixed.SIGNAL_PATTERNS:
        total = total + matches(folded, pattern).cast("int")
    return F.when(ascii_only, found["signals"]).otherwise(total)


def signal_term(signals: Column) -> Column:
    return F.least(signals * F.lit(fixed.PER_SIGNAL), F.lit(fixed.SIGNAL_LIMIT))


def vocabulary_term(words: Column) -> Column:
    total = words["total"]
    ratio = words["distinct"] / F.greatest(total, F.lit(1))
    bonus = (ratio - F.lit(fixed.VOCABULARY_CENTRE)) * F.lit(fixed.VOCABULARY_WEIGHT)
    return F.when(total >= fixed.VOCABULARY_MIN_WORDS, bonus).otherwise(F.lit(0.0))


def digest_modulus(hex_digest: Column) -> Column:
    """128-bit hex digest modulo 10000, from its two 64-bit halves."""
    def half(start: int) -> Column:
        number = F.conv(F.substring(hex_digest, start, 16), 16, 10).cast("decimal(20,0)")
        return (number % F.lit(fixed.JITTER_MODULUS)).cast("int")

    return (half(1) * _TWO_POW_64_MOD + half(17)) % fixed.JITTER_MODULUS


def jitter_term(text: Column) -> Column:
    """Same text, same value: a fixed offset in ±0.06 from the text's digest."""
    share = digest_modulus(F.md5(text)) / F.lit(float(fixed.JITTER_MODULUS))
    return (share - F.lit(0.5)) * F.lit(fixed.JITTER_WIDTH)


def confidence_terms(text: Column, folded: Column, ascii_only: Column, found: Column, words: Column,
                     priority: Column, hits: Column) -> dict[str, Column]:
    """The six addends, in the order they are summed."""
    return {
        "base": priority_base(priority),
        "hits": hit_term(hits),
        "length": length_term(text),
        "signals": signal_term(signal_count(folded, ascii_only, found)),
        "vocabulary": vocabulary_term(words),
        "jitter": jitter_term(text),
    }


def clamp_confidence(total: Column) -> Column:
    bounded = F.greatest(F.lit(fixed.CONFIDENCE_FLOOR), F.least(F.lit(fixed.CONFIDENCE_CEILING), total))
    return round_half_up(bounded, 4)


def calibrated(mean: Column, low: Column, valid: Column, clip: bool = True) -> Column:
    """Confidence from mean and minimum token probability; 0.0 for an invalid output."""
    score = F.lit(fixed.MEAN_WEIGHT) * mean + F.lit(fixed.MIN_WEIGHT) * low
    if clip:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(valid, round_half_up(score, 4)).otherwise(F.lit(0.0))


def token_confidence(probabilities: Column, valid: Column) -> Column:
    """The same over an array of token probabilities; an empty output counts as certain."""
    size = F.size(probabilities)
    total = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p)
    mean = F.when(size > 0, total / F.greatest(size, F.lit(1))).otherwise(F.lit(1.0))
    low = F.when(size > 0, F.array_min(probabilities)).otherwise(F.lit(1.0))
    return calibrated(mean, low, valid)


