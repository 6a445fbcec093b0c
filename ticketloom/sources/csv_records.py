"""CSV records with quoted line breaks, read by as many tasks as the files have splits.

A line alone does not tell whether it begins inside a quoted field, but it tells both answers: where it ends
if it begins outside quotes, and where if it begins inside. Each line is thus one of four functions on that bit.
Functions of lines combine by windows inside a split, and those of splits, one row each, along their file. Then every
line knows where it begins, records are counted in order, and only lines of records with breaks are put together.

A split is a group of its window, so it has a bounded size. A quote that is never closed makes one record of the
rest of its file, as for any reader of such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What follows an opening quote up to the closing one, and a whole field. A field that does not begin with a
# quote has no quoted part; behind a closing quote anything may follow up to the comma.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_OPENS = rf'(?s)^(?:{_FIELD},)*+"{_QUOTED}\z'
_STAYS = rf'(?s)^(?:{_QUOTED}|{_QUOTED}"[^,]*+,(?:{_FIELD},)*+"{_QUOTED})\z'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, split and place. A carriage return at the end stays."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mark"), F.col("value").alias("_line"))


def _state(since: Column, flips: Column, begin: Column) -> Column:
    """Whether a place is inside quotes: from the last line before it that ends alike either way, or else from
    ``begin``, turned by each line that turns it."""
    settled = since["inside"] != ((flips - since["flips"]) % 2 == 1)
    return F.when(since.isNotNull(), settled).otherwise(begin != (flips % 2 == 1))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """_file, _number (from 0 in its file, empty records not counted), _row and _record, a row per record. _row counts
    the records behind each file's first one, file after file by name, from 1; a first record has its successor's less one."""
    lines = _lines(spark, path).withColumns({
        "_opens": F.col("_line").rlike(_OPENS), "_stays": F.col("_line").rlike(_STAYS)})
    in_split = Window.partitionBy("_file", "_start").orderBy("_mark")
    upto, before = in_split.rowsBetween(Window.unboundedPreceding, 0), in_split.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("_opens") & ~F.col("_stays")).cast("int")
    counted = lines.withColumn("_flips", F.sum(turns).over(upto)).withColumn(
        "_settled", F.when(F.col("_opens") == F.col("_stays"), F.struct(F.col("_opens").alias("inside"), F.col("_flips").alias("flips"))))
    placed = counted.withColumns({
        "_since": F.last("_settled", ignorenulls=True).over(before), "_flips": F.coalesce(F.lag("_flips").over(in_split), F.lit(0)),
        "_all_flips": F.col("_flips"), "_last": F.col("_settled")})

    # One row per split: what it makes of a state, and how many records begin in it for either state at its begin.
    begins = {name: ~_state(F.col("_since"), F.col("_flips"), F.lit(inside)) for name, inside in (("_out", False), ("_in", True))}
    full = F.regexp_replace("_line", "\r\\z", "") != ""
    splits = placed.groupBy("_file", "_start").agg(
        F.max_by("_settled", F.when(F.col("_settled").isNotNull(), F.col("_mark"))).alias("_since"),
        F.max("_all_flips").alias("_flips"),
        *[F.count_if(begin & full).alias(f"_records{name}") for name, begin in begins.items()])
    along = Window.partitionBy("_file").orderBy("_start")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = splits.withColumn("_total", F.sum("_flips").over(along)).withColumn(
        "_fixed", F.when(F.col("_since").isNotNull(), F.struct(
            (F.col("_since.inside") != ((F.col("_flips") - F.col("_since.flips")) % 2 == 1)).alias("inside"), F.col("_total").alias("flips"))))
    states = summed.withColumn("_begin", _state(F.last("_fixed", ignorenulls=True).over(earlier),
                                                F.col("_total") - F.col("_flips"), F.lit(False)))
    own = F.when(F.col("_begin"), F.col("_records_in")).otherwise(F.col("_records_out"))
    # One small row per split of about 128 MB, so one task is fine: under a million rows for 100 TB.
    over_files = Window.orderBy("_file", "_start")
    heads = F.when((F.row_number().over(along) == 1) & (F.sum(own).over(Window.partitionBy("_file")) > 0), 1).otherwise(0)
    sized = states.withColumns({"_own": own, "_offset": F.coalesce(F.sum(own).over(earlier), F.lit(0)), "_head": heads})
    offsets = sized.select("_file", "_start", "_begin", "_offset", (
        F.coalesce(F.sum("_own").over(over_files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_offset")
        - F.sum("_head").over(over_files)).alias("_shift"))

    known = placed.join(F.broadcast(offsets), ["_file", "_start"])
    inside = _state(F.col("_since"), F.col("_flips"), F.col("_begin"))
    after = F.when(inside, F.col("_stays")).otherwise(F.col("_opens"))
    numbered = known.withColumns({"_inside": inside, "_after": after}).withColumn(
        "_number", F.col("_offset") + F.sum((~F.col("_inside") & full).cast("bigint")).over(upto) - 1).withColumn("_row", F.col("_number") + F.col("_shift") + 1)
    whole = numbered.filter(~F.col("_inside") & ~F.col("_after") & full).select("_file", "_number", "_row", F.col("_line").alias("_record"))
    pieces = numbered.filter(F.col("_inside") | F.col("_after")).groupBy("_file", "_number", "_row").agg(
        F.sort_array(F.collect_list(F.struct("_start", "_mark", "_line"))).alias("_pieces"))
    joined = pieces.select("_file", "_number", "_row", F.array_join(F.transform("_pieces", lambda p: p["_line"]), "\n").alias("_record"))
    text = F.regexp_replace("_record", "\r\\z", "")
    bare = F.when(F.col("_number") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return whole.unionByName(joined).withColumn("_record", bare)


OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"}


def fields(record: Column, count: int) -> Column:
    """A record's fields as a struct of ``count`` texts, as the CSV reader makes them."""
    return F.from_csv(record, ", ".join(f"f{i} string" for i in range(count)), OPTIONS)
