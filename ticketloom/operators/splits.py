"""Stratified splits that are exact, reproducible and independent of partitioning."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.seeded import digest
from ..scratch import passing, stored
from . import sieve
from .neardup import near_rows, without_near_rows
from .ordering import with_first

# Hex digits of the digest that form a slice: a stratum is counted in 65536 slices.
_SLICE_DIGITS = 4
# Remainders are counted in so many slices.
_REMAINDERS = 4096


def quotas(strata: DataFrame, share: str) -> DataFrame:
    """Test rows per stratum: ceil(share * rows) in all, by largest remainder.

    ``strata`` has one row per stratum with its size ``n``; there may be as many as rows. Remainders are
    counted in ``_REMAINDERS`` slices, whose counts show the one slice where the extra rows run out;
    only its strata are put in order, by range. Whole numbers throughout; ties go to the stratum that sorts first.
    """
    part = Fraction(share)
    top, bottom = part.numerator, part.denominator
    rest = F.col("n") * top % bottom
    sized = stored(strata.select("stratum", "n", F.floor(F.col("n") * top / bottom).cast("bigint").alias("quota"), rest.alias("_rest"),
                                 F.floor(rest * _REMAINDERS / bottom).cast("int").alias("_slice")), "strata")
    counts = sized.groupBy("_slice").agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("n"), F.sum("quota").alias("quota")).collect()
    rows, given = sum(c["n"] for c in counts), sum(c["quota"] for c in counts)
    missing, edge = -(-rows * top // bottom) - given, _REMAINDERS
    for count in sorted(counts, key=lambda c: -c["_slice"]):
        edge = count["_slice"]
        if count["strata"] >= missing:
            break
        missing -= count["strata"]
    extra = sized.filter(F.col("_slice") > edge).withColumn("quota", F.col("quota") + 1)
    at_edge = with_first(sized.filter(F.col("_slice") == edge), [F.desc("_rest"), F.col("stratum")], missing, "_extra")
    at_edge = at_edge.withColumn("quota", F.col("quota") + F.col("_extra").cast("bigint"))
    whole = sized.filter(F.col("_slice") < edge).unionByName(extra).unionByName(at_edge.drop("_extra"))
    return whole.select("stratum", "n", "quota")


def _with_stratum(rows: DataFrame, per_stratum: DataFrame) -> DataFrame:
    """Join one row per stratum; rows without a stratum are a stratum too."""
    named = per_stratum.withColumnRenamed("stratum", "_stratum")
    return rows.join(named, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum")


def quota_sample(df: DataFrame, key: str, stratum: Column, seed: int, wanted: DataFrame) -> DataFrame:
    """The rows of lowest seeded digest, ``quota`` of them in each stratum.

    A stratum may hold a third of all rows, so it is never sorted whole. Rows are counted by
    (stratum, slice of the digest); running sums of those counts show the one slice per stratum
    where the quota ends, and only that slice is ranked.
    """
    rows = df.select(F.col(key), stratum.alias("stratum"), digest(F.col(key), seed).alias("_digest"))
    rows = rows.withColumn("_slice", F.substring("_digest", 1, _SLICE_DIGITS))
    counts = rows.groupBy("stratum", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = _with_stratum(counts.withColumn("_upto", F.sum("_n").over(upto)), wanted.select("stratum", "quota"))
    edge = sums.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    edge = stored(edge.select("stratum", F.col("_slice").alias("_edge"),
                              (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take")), "edges")
    placed = _with_stratum(rows, edge)
    below = placed.filter(F.col("_slice") < F.col("_edge"))
    order = Window.partitionBy("stratum").orderBy("_digest", key)
    at_edge = placed.filter(F.col("_slice") == F.col("_edge")).withColumn(
        "_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_take"))
    return below.select(key).unionByName(at_edge.select(key))


def stratified_test_ids(df: DataFrame, key: str, stratum: Column, share: str, seed: int) -> DataFrame:
    """Keys of the test part: every stratum within one row of its share."""
    sizes = df.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return quota_sample(df, key, stratum, seed, quotas(sizes, share))


def combination(category: str = "category", priority: str = "priority",
                department: str = "department") -> Column:
    return F.concat_ws("|", category, priority, department)


def choose_strata(df: DataFrame, share: str, fine: Column, coarse: Column) -> tuple[str, Column]:
    """Strata that allow a stratified split: the fine ones, the coarse ones, or none.

    Fine strata need two rows each. Coarse strata need that too, and both parts must be able to
    hold every stratum. Only three counts come back to the driver.
    """
    sizes = df.groupBy(fine.alias("f"), coarse.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    by_fine = sizes.groupBy("f").agg(F.sum("n").alias("n")).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("strata"), F.sum("n").alias("rows")).first()
    by_coarse = sizes.groupBy("c").agg(F.sum("n").alias("n")).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("strata"), F.sum("n").alias("rows")).first()
    part = Fraction(share)

    def fits(found) -> bool:
        rows = found["rows"] or 0
        test = -(-rows * part.numerator // part.denominator)
        return (found["least"] or 0) >= 2 and test >= found["strata"] and rows - test >= found["strata"]

    if (by_fine["least"] or 0) >= 2:
        return ("fine", fine) if fits(by_fine) else ("none", F.lit("all"))
    return ("coarse", coarse) if fits(by_coarse) else ("none", F.lit("all"))


def stratified_split(df: DataFrame, key: str, share: str, seed: int,
                     fine: Column | None = None, coarse: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rest and test part, disjoint and exhaustive, with the fallback of ``choose_strata``."""
    fine = combination() if fine is None else fine
    coarse = F.col("category") if coarse is None else coarse
    _, stratum = choose_strata(df, share, fine, coarse)
    ids = stored(stratified_test_ids(df, key, stratum, share, seed), "test")
    return sieve.without(df, ids, key), sieve.only(df, ids, key)


def split_dataset(df: DataFrame, key: str, text: str, seed: int,
                  fine: Column | None = None, coarse: Column | None = None) -> dict[str, DataFrame]:
    """train, validation, test and future_test, each stored.

    The future set is carved out first and the pool loses rows close to it; validation and test
    then lose rows close to train. Validation and test are not compared with each other.
    """
    total = Fraction(fixed.VALIDATION_SHARE) + Fraction(fixed.TEST_SHARE)
    within = str(Fraction(fixed.TEST_SHARE) / total)
    with passing(df.sparkSession) as keep:
        # A text lies in two tables at most: the pool goes once train and the held rows are stored.
        with passing(df.sparkSession) as hand_on:
            pool, future = stratified_split(df, key, fixed.FUTURE_SHARE, seed, fine, coarse)
            future, pool = hand_on(stored(future, "future")), stored(pool, "pool")
            pool = without_near_rows(future, pool, key, text)
            train, held = stratified_split(pool, key, str(total), seed, fine, coarse)
            train, held = hand_on(stored(train, "train")), hand_on(stored(held, "held"))
        validation, test = stratified_split(held, key, within, seed, fine, coarse)
        # Both parts are of ``held``, so one search finds the rows of both.
        near = near_rows(train, held, key, text)
        parts = {"train": train, "validation": stored(sieve.without(validation, near, key), "validation"),
                 "test": stored(sieve.without(test, near, key), "test"), "future_test": future}
        return {name: keep(part) for name, part in parts.items()}


def split_sizes(parts: dict[str, DataFrame]) -> DataFrame:
    sizes = [part.agg(F.count(F.lit(1)).alias("tickets")).select(F.lit(name).alias("split"), "tickets")
             for name, part in parts.items()]
    result = sizes[0]
    for more in sizes[1:]:
        result = result.unionByName(more)
    return result
