"""Stored tables, what goes with the part of the job that needs them, and joins that leave most rows where they are."""

import os

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import neardup, sieve, splits
from ticketloom.scratch import checkpoint_folder, passing, stored


def tables(spark):
    folder = checkpoint_folder(spark)
    return {f"{folder}/{name}" for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_passing_tables_go(spark):
    before, rows = tables(spark), spark.range(5)
    with passing(spark) as keep:
        stored(rows, "a")
        with passing(spark) as hand_on:
            stored(rows, "b")
            handed, lost = hand_on(stored(rows, "c")), hand_on(stored(rows, "d"))
        assert len(tables(spark) - before) == 3 and handed.count() == lost.count() == 5
        kept = keep(handed)
    assert kept.count() == 5 and len(tables(spark) - before) == 1
    outside = stored(rows, "e")
    with pytest.raises(KeyError):
        with passing(spark) as keep:
            keep(stored(rows, "f"))
            raise KeyError
    assert outside.count() == 5 and len(tables(spark) - before) == 2


def test_setting_is_as_before(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name, None) is None
    counted = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored(counted, "counted").count() == stored(counted, "counted").count() == counted.count() == 7
    assert spark.conf.get(name, None) is None


def texts(spark):
    """Long unlike texts, a few near copies and exact copies."""
    words = F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id") % 380, i), F.lit(5000)).cast("string")))
    text = F.concat_ws(" ", words, F.when(F.col("id") % 3 == 0, F.lit("last")))
    return stored(spark.range(400).select("id", text.alias("text"), F.lit("a").alias("category"), F.lit("b").alias("priority"), F.lit("c").alias("department")), "texts")


def test_a_split_leaves_its_parts_only(spark):
    rows = texts(spark)
    before = tables(spark)
    parts = splits.split_dataset(rows, "id", "text", 3)
    assert len(tables(spark) - before) == len(parts) == 4
    assert sum(part.count() for part in parts.values()) <= 400 and parts["future_test"].count() == 40


def test_only_sets_with_a_candidate_are_stored(spark, monkeypatch):
    """A set is as long as its text: a table of all of them, or of all texts, is not written, nor are parts written twice."""
    rows, written = texts(spark), []

    def watched(df, label):
        table = stored(df, label)
        written.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(neardup, "stored", watched)
    before = tables(spark)
    near = neardup.near_rows(rows.filter("id < 100"), rows.filter("id >= 100"), "id", "text")
    # Texts 380 to 399 repeat 0 to 19, with another end or without.
    assert {r.id for r in near.collect()} == set(range(380, 400))
    assert sorted(n for columns, n in written if "own" in columns) == [100, 300]
    assert all(n <= 20 for columns, n in written if {"sh", "text"} & {*columns})
    assert len(tables(spark) - before) == 1


@pytest.mark.parametrize("key", ["id", "name"])
@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_sieve_is_a_join(spark, monkeypatch, key, bits):
    rows = spark.range(3000).select((F.when(F.col("id") % 11 != 0, F.col("id") % 1000)).alias("id"), F.col("id").alias("place"))
    rows = rows.withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    keys = stored(rows.filter("place % 3 = 0").select(key), "keys")
    monkeypatch.setattr(sieve, "BITS", bits)
    for few in (100_000, 5):
        monkeypatch.setattr(sieve, "FEW", few)
        for found, how in ((sieve.only, "left_semi"), (sieve.without, "left_anti")):
            got, want = found(rows, keys, key), rows.join(keys, key, how)
            assert got.columns == want.columns and sorted(got.select("place").collect()) == sorted(want.select("place").collect()) != []
    assert sieve.only(rows, keys.limit(0), key).isEmpty() and sieve.without(rows, keys.limit(0), key).count() == 3000


def test_no_text_moves_for_a_key(spark, monkeypatch):
    """Rows are looked up in a bitmap before the join, when the keys are too many for a broadcast."""
    monkeypatch.setattr(sieve, "FEW", 5)
    rows = stored(spark.range(2000).select("id", F.repeat(F.lit("text "), 50).alias("text")), "rows")
    keys = stored(spark.range(1000, 1100), "keys")
    moved = []
    for found in (sieve.only, sieve.without):
        plan = found(rows, keys, "id")._jdf.queryExecution().optimizedPlan().toString()
        moved.append(plan.count("_may") + plan.count("_bitmap"))
    assert all(moved)
