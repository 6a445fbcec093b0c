"""Searches in batches of texts, for Arrow UDFs: each pattern is one pass of a linear-time matcher over a batch.

The functions travel to the workers by value, so workers need not find this package.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def found(texts: pa.Array, pattern: str) -> np.ndarray:
    """Whether the pattern is somewhere in each text; not in a null."""
    return pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)


def any_word(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


def first_list_hits(texts: pa.Array, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The first list of words of which a text contains one, and of how many; the last list and 0 when none has one.

    A list is searched as one pattern, in the texts that no list before it settled; words are counted only where it is found.
    """
    hits = np.zeros(len(texts), dtype=np.int32)
    which = np.full(len(texts), len(lists) - 1, dtype=np.int32)
    rows = np.arange(len(texts))
    for number, words in enumerate(lists):
        here = found(texts, any_word(words))
        hits[rows[here]] = [sum(word in text for word in words) for text in texts.filter(pa.array(here)).to_pylist()]
        which[rows[here]] = number
        rows, texts = rows[~here], texts.filter(pa.array(~here))
    return hits, which


def first_list(lists: list[list[str]], ranks: int) -> Callable:
    """``hits * ranks + list number`` of ``first_list_hits``, as the function of an Arrow UDF."""
    def numbers(texts: pa.Array) -> pa.Array:
        hits, which = first_list_hits(texts, lists)
        return pa.array(hits * ranks + which)
    return numbers


def linear(pattern: str) -> str:
    """The pattern as the matcher reads it: a dot takes line ends, and white space has the vertical tab, as in Java."""
    return "(?s)" + pattern.replace(r"\s", r"[\t-\r ]")


def first_rule(texts: pa.Array, rules: list[str], any_rule: str) -> np.ndarray:
    """The number of the first rule that is found, from 1; 0 for none. Single rules are tried only where ``any_rule`` is found."""
    number = np.zeros(len(texts), dtype=np.int32)
    here = found(texts, any_rule)
    rows, texts = np.flatnonzero(here), texts.filter(pa.array(here))
    for i in range(len(rules), 0, -1):
        number[rows[found(texts, rules[i - 1])]] = i
    return number


def signs(signals: list[str], rules: list[str], any_rule: str, high: str) -> Callable:
    """Of lower-case ASCII texts: how many signals are found, the number of the first rule, and whether ``high`` is found."""
    signals, rules, any_rule, high = list(map(linear, signals)), list(map(linear, rules)), linear(any_rule), linear(high)

    def of(texts: pa.Array) -> pa.Array:
        count = sum((found(texts, pattern).astype(np.int32) for pattern in signals), np.zeros(len(texts), dtype=np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(count), pa.array(first_rule(texts, rules, any_rule)), pa.array(found(texts, high))], names=["signals", "rule", "high"])
    return of


def vocabulary(texts: pa.Array) -> pa.Array:
    """The number of words and of different words of each text; a null text has none."""
    words = [text.split() for text in texts.fill_null("").to_pylist()]
    return pa.StructArray.from_arrays([pa.array(map(len, words), pa.int32()), pa.array([len(set(w)) for w in words], pa.int32())],
                                      names=["total", "distinct"])
