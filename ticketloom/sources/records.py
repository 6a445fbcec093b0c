"""Nested ticket records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators.ordering import number_file_rows

CORRUPT = "_corrupt"

RECORD_SCHEMA = T.StructType([
    T.StructField("fields", T.StructType([T.StructField(f, T.StringType()) for f in fixed.FIELDS])),
    T.StructField("metadata", T.StructType(
        [T.StructField(f, T.StringType()) for f in fixed.METADATA[:-1]]
        + [T.StructField(fixed.METADATA[-1], T.IntegerType())])),
])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``fields`` and ``metadata``; blank lines are skipped, the text of a line that
    does not parse is kept in ``_corrupt``."""
    schema = T.StructType(RECORD_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw non-blank lines with ``line_no``, their 1-based number in the file, for validation."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return number_file_rows(lines, "line_no").filter(F.trim("line") != "")


def write_records(df: DataFrame, path: str) -> None:
    df.select("fields", "metadata").write.json(path, ignoreNullFields=False)


def nest(df: DataFrame) -> DataFrame:
    """Flat columns to the nested record form."""
    metadata = [F.col(c).cast("int").alias(c) if c == "key_index" else F.col(c) for c in fixed.METADATA]
    return df.select(F.struct(*fixed.FIELDS).alias("fields"), F.struct(*metadata).alias("metadata"))


def flatten(records: DataFrame) -> DataFrame:
    """Master table: the eight fields and eight metadata columns side by side."""
    return records.select("fields.*", "metadata.*")
