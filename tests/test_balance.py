"""Work that must be done once for a row, and rows that must not lie in one task."""

from pyspark.sql import functions as F

from ticketloom.operators import ingest, triage
from ticketloom.sources import store


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_lowered_once_for_a_row_not_for_each_word(spark):
    rows = spark.createDataFrame([(1, "My INVOICE shows a wrong charge")], "id long, review string")
    labels = triage.with_keyword_labels(rows).select("id", "predicted_category")
    assert "contains(lower" not in plan_of(labels)
    assert labels.first().predicted_category == "Billing"


def test_the_filter_of_reviews_names_the_review_once(spark):
    rows = spark.createDataFrame([(1, " a "), (2, " NaN "), (3, "  "), (4, None), (5, "nan b")], "id long, review string")
    kept = ingest.clean_reviews(rows)
    assert [(r.id, r.review) for r in kept.orderBy("id").collect()] == [(1, "a"), (5, "nan b")]
    assert next(line for line in plan_of(kept).splitlines() if "Filter" in line).count("trim(") <= 1


def test_one_row_group_in_many_splits_is_spread_and_filters_stay_above(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(60_000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        source = spark.read.parquet(path)
        assert source.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        kept = store.balanced(source, keep=True)
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) <= 20_000
        assert "Repartition" not in plan_of(kept.filter(F.lower("text") != ""))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
