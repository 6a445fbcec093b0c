"""Text clean-up, words, shingles and masking as column expressions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fixed

_KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold_case(text: Column) -> Column:
    """Lower case for rule matching; maps the few letters whose folding is not their lower case."""
    plain = F.lower(text)
    return F.when(is_ascii(text), plain).otherwise(F.lower(F.translate(text, "İıſK", "iisk")))


def matches(folded: Column, pattern: str) -> Column:
    """Pattern search in case-folded text of any script. It costs much more than ``batches`` takes for ASCII text."""
    return folded.rlike("(?sU)" + pattern)


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of ``\\b(...)\\b``."""
    body = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    parts, depth = [""], 0
    for char in body:
        depth += (char == "(") - (char == ")")
        if char == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def any_of(patterns: list[str]) -> str:
    """One pattern that is found where any of the ``\\b(...)\\b`` is.

    Edges are tested once, and alternatives are grouped by their first letter, so that most of
    them are ruled out together.
    """
    groups: dict[str, list[str]] = {}
    for alternative in (a for p in patterns for a in _alternatives(p)):
        plain = re.match(r"[a-z](?![?*+{])", alternative)
        groups.setdefault(plain.group() if plain else "", []).append(alternative)
    parts = [f"{first}(?:{'|'.join(a[len(first):] for a in group)})" for first, group in groups.items()]
    return r"\b(?:" + "|".join(parts) + r")\b"


def normalized_words(text: Column) -> Column:
    """Lower-case words of letters and digits; everything else separates."""
    spaced = F.when(is_ascii(text), F.regexp_replace(text, "[^a-zA-Z0-9]+", " ")).otherwise(
        F.translate(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), "Σ", "σ"))
    return F.array_remove(F.split(F.lower(spaced), " "), "")


def kept_characters(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """The characters that ``normalized_words`` keeps, as code points, and what each becomes there, as a number: its code
    point, or one beyond all code points where it becomes several characters. Spark itself is asked, once in an application,
    since other Unicode tables may be of another version."""
    application = spark.sparkContext.applicationId
    if application not in _KEPT:
        points = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF)).select(
            "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("char"))
        kept = points.select("id", F.get(normalized_words(F.col("char")), F.lit(0)).alias("word")).filter("word is not null").toArrow()
        words = kept.column("word").to_pylist()
        several = {word: 0x110000 + i for i, word in enumerate(sorted({w for w in words if len(w) > 1}))}
        _KEPT[application] = (kept.column("id").to_numpy(), np.array([several.get(w) or ord(w) for w in words], dtype=np.int64))
    return _KEPT[application]


def shingles(words: Column, width: int = fixed.SHINGLE_WORDS) -> Column:
    """Distinct runs of ``width`` words; a shorter text is one shingle, even when empty.

    Give ``words`` as a stored column: it is read several times.
    """
    runs_count = F.size(words) - (width - 1)
    length = F.greatest(runs_count, F.lit(0))
    runs = F.slice(words, 1, length)
    for start in range(2, width + 1):
        runs = F.zip_with(runs, F.slice(words, start, length), lambda run, word: F.concat_ws(" ", run, word))
    return F.array_distinct(F.when(runs_count > 0, runs).otherwise(F.array(F.array_join(words, " "))))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0.0 when either is empty."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(common / union)


def mask_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"(?U)\D", "")
    hidden = F.lit("****")
    return (
        F.when(phone.isNull() | (F.length(phone) < 6), hidden)
        .when(F.length(digits) >= 10,
              F.concat(F.lit("+91-"), F.substring(digits, 1, 2), hidden, F.substring(digits, -4, 4)))
        .otherwise(F.concat(F.substring(phone, 1, 2), hidden, F.substring(phone, -2, 2)))
    )


def mask_cards(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + fixed.CARD_PATTERN, fixed.CARD_MASK)


def mask_codes(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + fixed.CODE_PATTERN, "$1 " + fixed.CODE_MASK)


def sanitize(text: Column) -> Column:
    """Cards first, then one-time codes, then strip."""
    return strip(mask_codes(mask_cards(text)))
