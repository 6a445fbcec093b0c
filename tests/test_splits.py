from fractions import Fraction
from math import ceil

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import neardup, splits


def rows(spark):
    """One stratum holds most rows, one has a single row."""
    data = [(i, "hot" if i % 10 else f"s{i // 10 % 6}", f"text {i} " + " ".join(f"t{i}{j}" for j in range(8)))
            for i in range(2000)] + [(5000, "single", "alone in here")]
    return spark.createDataFrame(data, "id bigint, stratum string, text string")


@pytest.mark.parametrize("share", ["0.10", "0.30", "1/2"])
def test_quota_split(spark, share):
    df = rows(spark)
    ids = splits.stratified_test_ids(df, "id", F.col("stratum"), share, 42)
    test = df.join(ids, "id", "left_semi")
    assert ids.count() == test.count() == ceil(2001 * Fraction(share))
    sizes = {r[0]: r[1] for r in df.groupBy("stratum").count().collect()}
    parts = {r[0]: r[1] for r in test.groupBy("stratum").count().collect()}
    for stratum, n in sizes.items():
        assert abs(parts.get(stratum, 0) - n * float(Fraction(share))) < 1
    again = splits.stratified_test_ids(df.repartition(3), "id", F.col("stratum"), share, 42)
    assert sorted(ids.collect()) == sorted(again.collect())


def test_fallback(spark):
    df = rows(spark).withColumn("coarse", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    assert splits.choose_strata(df, "0.30", F.col("stratum"), F.col("coarse"))[0] == "coarse"
    assert splits.choose_strata(df.filter("stratum <> 'single'"), "0.30", F.col("stratum"), F.col("coarse"))[0] == "fine"
    assert splits.choose_strata(df, "0.30", F.col("id"), F.col("stratum"))[0] == "none"


def test_split_dataset(spark):
    df = rows(spark).unionByName(spark.createDataFrame(
        [(9000 + i, "hot", f"the same complaint about the same broken thing again and again number {i % 3}") for i in range(40)],
        "id bigint, stratum string, text string"))
    parts = splits.split_dataset(df, "id", "text", 42, F.col("stratum"), F.lit("all"))
    ids = {name: {r.id for r in part.select("id").collect()} for name, part in parts.items()}
    names = list(ids)
    assert all(ids[a].isdisjoint(ids[b]) for i, a in enumerate(names) for b in names[i + 1:])
    assert len(ids["future_test"]) == ceil(2041 * 0.1)
    for part in ("validation", "test"):
        assert neardup.near_rows(parts["train"], parts[part], "id", "text").isEmpty()
    assert neardup.near_rows(parts["future_test"], parts["train"], "id", "text").isEmpty()


def test_rows_without_a_stratum_are_a_stratum(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id long, s string")
    ids = {r.id for r in splits.stratified_test_ids(rows, "id", F.col("s"), "0.30", 7).collect()}
    assert len(ids) == 6 and sum(i % 2 for i in ids) == 3


def by_hand(sizes, share):
    """Largest remainder; ties go to the stratum that sorts first, none before all others."""
    part = Fraction(share)
    base = {s: int(n * part) for s, n in sizes.items()}
    missing = ceil(sum(sizes.values()) * part) - sum(base.values())
    order = sorted(sizes, key=lambda s: (-(sizes[s] * part - base[s]), s is not None, s or ""))
    return {s: base[s] + (s in order[:missing]) for s in sizes}


@pytest.mark.parametrize("share", ["0.10", "0.30", "1/2", "1/7", "0.123456789", "1", "0"])
@pytest.mark.parametrize("strata", [0, 1, 7, 500])
def test_quotas_by_hand(spark, share, strata):
    sizes = {(None if i == 3 else f"s{i * 7919 % 1000:03}"): 1 + i * i % 23 for i in range(strata)}
    found = splits.quotas(spark.createDataFrame(list(sizes.items()), "stratum string, n long"), share).collect()
    assert {r.stratum: r.quota for r in found} == by_hand(sizes, share) and len(found) == strata


def test_very_many_strata(spark):
    """As many strata as rows: no task sees them all, and the total is exact."""
    strata = spark.range(2_000_000).select(F.format_string("s%d", "id").alias("stratum"), (F.col("id") % 3 + 1).alias("n"))
    found = splits.quotas(strata, "0.30")
    assert "SinglePartition" not in found._jdf.queryExecution().toString() and "Window" not in found._jdf.queryExecution().toString()
    rows = 2_000_000 // 3 * 6 + 3
    assert found.agg(F.sum("quota"), F.sum("n")).first()[:] == (ceil(rows * Fraction("0.30")), rows)


def test_held_rows_are_cut_into_shingles_once(spark, monkeypatch):
    """The future set and its pool, then train and all held rows: four passes over texts, whatever parts follow."""
    passes, rows = [], neardup.shingle_rows

    def counted(*args):
        passes.append(args)
        return rows(*args)

    monkeypatch.setattr(neardup, "shingle_rows", counted)
    df = spark.range(80).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(5)]).alias("text"),
                                F.lit("a").alias("category"), F.lit("b").alias("priority"), F.lit("c").alias("department"))
    splits.split_dataset(df, "id", "text", 3)
    assert len(passes) == 4
