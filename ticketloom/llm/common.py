"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) - len(c.lstrip("_")) for c in taken), default=0)
    return ["_" * (longest + 1) + name for name in wanted]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` has lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(key: str) -> Column:
    """The fold that no model learns labels from: crc32 of the key as text, modulo 5, is 0.
    A null key counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def share_below(key: Column, wanted: int, rows: int) -> Column:
    """Whether a hash of ``key`` puts a row among about ``wanted`` of ``rows``. It goes before a top-k, so
    that tasks pass on few rows however many tasks there are."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 32)) < int(min(1.0, wanted / max(rows, 1)) * (1 << 32))


def rows_of(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A small table from values of the program, without a Python RDD."""
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS `{c}`" for c, t in columns.items()) + " WHERE false")
    items = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items())]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))
