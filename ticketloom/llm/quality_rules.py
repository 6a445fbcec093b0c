"""Quality rules (operator 8): a threshold table compiled into one Spark projection.

Every measure of a text is a column expression, and every row of the threshold table becomes one
comparison of two measures, so a table scan with one projection judges a document. There is no
user function, no shuffle and no collected group.

Defined cases: a null or empty text has no words and fails the base rules; a text of any length is
judged whole; equal rows are judged alike; an empty table gives an empty result. Only the two named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be by for from in is it not of on or that the this to was were with
auf das dem den der des die ein eine für im in ist mit nicht sich und von zu
au dans de des du elle en est et il la le les ne pas par pour que qui sur un une
al como con de del el en es la las lo los no o para por que se su un una y
""".split()


@dataclass(frozen=True)
class Threshold:
    """``low * denominator <= numerator <= high * denominator``; None leaves a side open."""
    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def failed(self, measures: dict[str, Column]) -> Column:
        over, under = measures[self.numerator], measures[self.denominator]
        sides = []
        if self.low is not None:
            sides.append(over < under * F.lit(float(self.low)))
        if self.high is not None:
            sides.append(over > under * F.lit(float(self.high)))
        return sides[0] if len(sides) == 1 else sides[0] | sides[1]


THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.5, 12.0),
    Threshold("symbols", "n_symbols", "n_words", None, 0.1),
    Threshold("stop_words", "n_stop_words", "n_words", 0.08, None),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
)


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for other in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def _window_hashes(word_hashes: Column, n_words: Column, length: int) -> Column:
    """A 64-bit hash of each window of ``length`` words, by first word."""
    starts = F.when(n_words >= length, F.sequence(F.lit(0), n_words - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(length)]))


def _all_differ(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def _covered_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are sorted with their positions, so
    equal ones are neighbours; the positions found, sorted, tell how far the windows overlap."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, k: (e.h == F.get(pairs, k - 1).h).eqNullSafe(True)
                         | (e.h == F.get(pairs, k + 1).h).eqNullSafe(True))
        return F.sort_array(F.transform(twice, lambda e: e.i))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    return let(let(by_hash, positions), covered)


def measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: the key and the counts that thresholds compare."""
    source = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = source.select(
        "_key", words_of(F.col("_text")).alias("_words"),
        F.regexp_count("_text", F.lit("[" + SYMBOLS + "]")).alias("_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"))
    hashed = split.select(
        "_key", "_symbols", F.size("_words").alias("_n"),
        F.char_length(F.array_join("_words", "")).alias("_word_chars"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin([*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]))).alias("_stop"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    # Windows of half the length differ in most texts, and then the whole windows differ too.
    windowed = hashed.withColumn("_halves", _window_hashes(F.col("_hashes"), F.col("_n"), WINDOW // 2))
    repeats = F.when(_all_differ(F.col("_halves")), F.lit(0)).otherwise(
        let(_window_hashes(F.col("_hashes"), F.col("_n"), WINDOW),
            lambda windows: F.when(_all_differ(windows), F.lit(0)).otherwise(_covered_words(windows))))
    return windowed.select(
        F.col("_key").alias(key), F.col("_n").cast("bigint").alias("n_words"),
        F.col("_word_chars").cast("bigint").alias("word_chars"), F.col("_symbols").cast("bigint").alias("n_symbols"),
        F.col("_dup_lines").cast("bigint").alias("n_dup_lines"), repeats.cast("bigint").alias("n_repeat_words"),
        F.col("_stop").cast("bigint").alias("n_stop_words"), F.col("_n_lines").cast("bigint").alias("n_lines"))


def judge(df: DataFrame, key: str, text: str, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The measures with ``base_failed``, the names of the thresholds a text fails, and ``kept``."""
    counted = measures(df, key, text)
    columns = {name: F.col(name) for name in counted.columns if name != key}
    failed = [F.when(t.failed(columns), F.lit(t.name)) for t in thresholds]
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return counted.withColumns({"base_failed": base, "failed_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
