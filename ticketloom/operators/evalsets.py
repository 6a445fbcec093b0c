"""Evaluation, demonstration and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.seeded import digest
from .splits import quota_sample


def rows_with_ids(master: DataFrame, ids: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Master rows, with all metadata, whose id is among ``ids``."""
    return master.join(ids.select(key), key, "left_semi")


def edge_cases(df: DataFrame) -> DataFrame:
    return df.filter(F.col("difficulty").isin("hard", "ambiguous"))


def shuffled_head(df: DataFrame, rows: int, seed: int, stream: str, key: str = "ticket_id") -> DataFrame:
    """The first rows of a seeded shuffle: a top-k by digest, no full sort."""
    return df.orderBy(digest(F.col(key), seed, stream), F.col(key)).limit(rows)


def priority_stress(df: DataFrame, seed: int, key: str = "ticket_id") -> DataFrame:
    """All Critical rows and as many shuffled High rows, at least ten.

    The number of High rows grows with the data, so they are picked by quota, not by a top-k.
    """
    critical = df.filter(F.col("priority") == "Critical")
    high = df.filter(F.col("priority") == "High")
    counts = df.agg(F.count_if(F.col("priority") == "Critical").alias("_c"),
                    F.count_if(F.col("priority") == "High").alias("_h"))
    wanted = counts.select(F.lit("High").alias("stratum"),
                           F.least(F.greatest("_c", F.lit(10)), "_h").alias("quota"))
    chosen = quota_sample(high, key, F.lit("High"), seed, wanted)
    return critical.unionByName(high.join(chosen, key, "left_semi"))


def review_simulation(df: DataFrame, seed: int, rows: int = 50) -> DataFrame:
    return shuffled_head(df, rows, seed, "review")


def demo_set(df: DataFrame, seed: int, rows: int = 15) -> DataFrame:
    return shuffled_head(df.filter(F.col("difficulty") == "easy"), rows, seed, "demo")


def chat_examples(df: DataFrame) -> DataFrame:
    """System, user and assistant message of each labelled ticket.

    The label JSON has a blank after each colon and comma, as usual in Python.
    """
    def quoted(column: str) -> Column:
        text = F.to_json(F.array(F.col(column)))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    answer = F.concat(
        F.lit('{"category": '), quoted("category"), F.lit(', "priority": '), quoted("priority"),
        F.lit(', "department": '), quoted("department"), F.lit("}"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    prompt = [message("system", F.lit(fixed.SYSTEM_PROMPT)), message("user", F.col("review"))]
    return df.select("ticket_id", F.array(*prompt).alias("prompt_messages"),
                     F.array(*prompt, message("assistant", answer)).alias("full_messages"))
