"""A corpus pipeline: language ID, line dedup, near-dedup, secret masking, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it decides
takes effect. All but the last return the columns of ``documents``: doc_id, text, lang and n_chars are read, others pass
through. Rows that share an id, or have none, are documents of their own, but for line dedup, where a line counts once for an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import language_id, line_dedup, minhash_forest, packing, secret_scan
from ticketloom.llm.common import table
from ticketloom.llm.queries import tokenizer_path
from ticketloom.scratch import stored

# Language ID and secret scans are trained models, which SQL cannot express.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; ``lang`` stays as it was given."""
    model = language_id.train(docs, "doc_id", "text", "lang")
    return language_id.keep_accepted(docs, "text", model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that another one keeps."""
    kept = line_dedup.deduplicate(docs, "doc_id", "text")
    return _counted(kept.withColumn("text", F.col("kept_text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by shingles of five words: that of the smallest id. Every row is a
    document of its own here, also where rows share an id or have none."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = minhash_forest.near_duplicates(rows, "_row", "text").select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row"))
    chosen = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(first.alias("_first"))
    return rows.join(chosen.select(F.col("_first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return _counted(secret_scan.mask(docs, "text", secret_scan.trained()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in a training sequence."""
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
