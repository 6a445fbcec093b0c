"""CSV uploads of tickets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import csv_records

_ALIASES = {
    "review": fixed.REVIEW_HEADERS,
    "customer_name": fixed.NAME_HEADERS,
    "contact_number": fixed.CONTACT_HEADERS,
    "timestamp": fixed.TIME_HEADERS,
}


class UploadError(ValueError):
    """The file cannot be used as a ticket upload."""


_OPTIONS = dict(multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _names(header) -> list[str]:
    """Column names of a header. Of equal headers the first keeps its name, of those that differ by case the last."""
    names = [name or "" for name in header or ()]
    if len({name.lower() for name in names}) == len(names):
        return [name or f"_c{i}" for i, name in enumerate(names)]
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    last = {name.lower(): i for name, i in sorted(first.items(), key=lambda item: item[1])}
    return [name if last[name.lower()] == i else f"_c{i}" for i, name in enumerate(names)]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV for a look at its first rows: all columns as text, a file by one task."""
    header = spark.read.csv(path, header=False, **_OPTIONS).first()
    return spark.read.csv(path, header=True, enforceSchema=True, **_OPTIONS).toDF(*_names(header))


def _read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with ``row_number``, all other columns as text, a task for each split of a file."""
    header = spark.read.csv(path, header=False, **_OPTIONS).first()
    names, count = _names(header), len(header or ())
    rows = csv_records.read_records(spark, path).withColumn("_f", csv_records.fields(F.col("_record"), count))
    expected = F.array(*[F.lit(name or "") for name in header or ()])
    found = F.array(*[F.coalesce(F.col(f"_f.f{i}"), F.lit("")) for i in range(count)])
    same = F.transform(found, F.lower) == F.transform(expected, F.lower)
    other = F.raise_error(F.concat(F.lit("The files of an upload differ in their headers: "), F.col("_file")))
    data = rows.filter(F.when(F.col("_number") > 0, True).when(same, False).otherwise(other.cast("boolean")))
    return data.select(*[F.col(f"_f.f{i}").alias(name) for i, name in enumerate(names)], F.col("_row").alias("row_number"))


def pick_columns(df: DataFrame) -> DataFrame:
    """Select review, customer_name, contact_number and timestamp by their accepted headers.

    Headers are compared trimmed and lower-cased; the first accepted name present wins. A missing
    optional column becomes null, a missing review column is an error.
    """
    present = {name.lower().strip(): name for name in df.columns if not name.startswith("_c")}
    picked = []
    for target, names in _ALIASES.items():
        source = next((present[n] for n in names if n in present), None)
        if source is None and target == "review":
            raise UploadError("No column holds the complaint: name one of them " + ", ".join(names))
        if source is None:
            column = F.lit(None).cast("string")
        else:
            column = F.col(f"`{source}`")
            column = F.when(~column.isin(fixed.MISSING_TEXTS), column)
        picked.append(column.alias(target))
    return df.select(*picked, *[c for c in ("row_number",) if c in df.columns])


def read_tickets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded tickets with their 1-based row number in file order. Fields may hold quoted line breaks."""
    look = _read(spark, path)
    if not look.columns or look.isEmpty():
        raise UploadError("The upload has no rows.")
    return pick_columns(_read_parallel(spark, path))


def preview(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    """The first rows of an upload, file by file in order of name, under its own headers; files after
    them are not read."""
    whole = _read(spark, path)
    shown, missing = [whole.limit(0)], rows
    for file in sorted(whole.inputFiles()):
        first = _read(spark, file).limit(missing)
        shown.append(first)
        missing -= first.count()
        if missing <= 0:
            break
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shown)


def write_csv(df: DataFrame, path: str, columns: list[str] = fixed.FIELDS) -> None:
    """Write the named columns with a header, quoting so that any text reads back unchanged."""
    df.select(*columns).write.csv(path, header=True, quote='"', escape='"',
                                  ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
