from pyspark.sql import functions as F

from ticketloom.sources import search_index


def test_letters_are_split_once_for_a_text_not_for_each_gram(spark):
    rows = spark.createDataFrame([("abcab",), ("é😀x",), ("ab",), ("",), (None,)], "t string")
    found = rows.select(search_index.grams(F.col("t")).alias("g"))
    assert [sorted(r.g) for r in found.collect()] == [["abc", "bca", "cab"], ["é😀x"], [], [], []]
    plan = rows.select(search_index.grams(F.col("t"))).repartition(2)._jdf.queryExecution().analyzed().toString()
    assert "get(split" not in plan
