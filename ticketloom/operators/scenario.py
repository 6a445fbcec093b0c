"""Plans for synthetic tickets. Every draw is a hash of the row's key, so a plan does not depend
on how it is partitioned and any part of it can be rebuilt alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scoring import default_department
from ..functions.seeded import (below_percent, by_label, digest, draw, pick, uniform_index, weighted)

_BLOCK = 10_000


def plan_keys(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(size).withColumnRenamed("id", "plan_id")


def scenario_plan(keys: DataFrame, seed: int, key: str = "plan_id") -> DataFrame:
    """Category, priority, department, scenario and difficulty for each key.

    Draws follow the weights; ``shuffle_key`` orders the plan randomly for whoever needs that.
    """
    df = keys.withColumns({"_a": digest(F.col(key), seed, "a"), "_b": digest(F.col(key), seed, "b")})
    df = df.withColumn("category", weighted(draw(F.col("_a"), 0), fixed.CATEGORY_WEIGHTS))
    category = F.col("category")
    priority_draw, scenario_draw, difficulty_draw = (draw(F.col("_a"), i) for i in (1, 2, 3))
    cross_draw, department_draw = draw(F.col("_b"), 0), draw(F.col("_b"), 1)
    cross = by_label(category, {c: pick(department_draw, d) for c, d in fixed.CROSS_DEPARTMENTS.items()})
    goes_across = below_percent(cross_draw, fixed.CROSS_DEPARTMENT_PERCENT) & category.isin(
        list(fixed.CROSS_DEPARTMENTS))
    return df.withColumns({
        "priority": by_label(category, {c: weighted(priority_draw, w) for c, w in fixed.PRIORITY_WEIGHTS.items()}),
        "department": F.when(goes_across, cross).otherwise(default_department(category)),
        "scenario": _scenario(category, scenario_draw),
        "difficulty": weighted(difficulty_draw, fixed.DIFFICULTY_WEIGHTS),
        "shuffle_key": F.substring("_b", 17, 16),
    }).select(key, "category", "priority", "department", "scenario", "difficulty", "shuffle_key")


def _scenario(category: Column, number: Column) -> Column:
    return by_label(category, {c: pick(number, s) for c, s in fixed.SCENARIOS.items()})


def plan_summary(plan: DataFrame) -> DataFrame:
    """Plan size and counts by category, priority, department and difficulty."""
    attributes = ["category", "priority", "department", "difficulty"]
    grouped = plan.groupingSets([[F.col(a)] for a in attributes] + [[]], *attributes).agg(
        F.count(F.lit(1)).alias("tickets"), F.grouping_id().alias("_g"))
    name = F.when(F.col("_g") == 15, "total")
    for i, a in enumerate(attributes):
        name = name.when(F.col("_g") == 15 - (8 >> i), a)
    return grouped.select(name.alias("attribute"), F.coalesce(*attributes, F.lit("all")).alias("value"), "tickets")


def synthetic_customers(keys: DataFrame, seed: int, as_of: Column, key: str = "plan_id") -> DataFrame:
    """Add a made-up name, phone number and time of the last half year."""
    df = keys.withColumns({"_c": digest(F.col(key), seed, "c"), "_d": digest(F.col(key), seed, "d")})
    first, last, prefix = (draw(F.col("_c"), i) for i in range(3))
    rest = uniform_index(draw(F.col("_c"), 3), 100_000_000).cast("string")
    days = uniform_index(draw(F.col("_d"), 0), fixed.TIMESTAMP_DAYS + 1)
    hours = uniform_index(draw(F.col("_d"), 1), fixed.TIMESTAMP_HOURS + 1)
    return df.withColumns({
        "customer_name": F.concat_ws(" ", pick(first, fixed.FIRST_NAMES), pick(last, fixed.LAST_NAMES)),
        "contact_number": F.concat(F.lit("+91"), pick(prefix, fixed.PHONE_PREFIXES), F.lpad(rest, 8, "0")),
        "timestamp": as_of - F.make_dt_interval(days, hours),
    }).drop("_c", "_d")


def topup_targets(spark: SparkSession) -> DataFrame:
    """The standing list of combinations to top up."""
    return spark.createDataFrame(fixed.TOPUP_TARGETS, "category string, priority string, department string, n bigint")


def shortfalls(combinations: DataFrame) -> DataFrame:
    """Top-up targets from combination counts: what each one lacks to the rounded-up mean.

    There is one row per label combination, so one task is enough.
    """
    everything = Window.partitionBy(F.lit(1))
    mean = F.ceil(F.sum("tickets").over(everything) / F.count(F.lit(1)).over(everything))
    return combinations.select(
        "category", "priority", "department", (mean - F.col("tickets")).cast("bigint").alias("n")
    ).filter("n > 0")


def topup_plan(targets: DataFrame, seed: int) -> DataFrame:
    """Each target row repeated ``n`` times, with a scenario and a difficulty drawn for each.

    A large target is first cut into blocks that are spread over the tasks, so no task holds the
    whole sequence.
    """
    combo = ["category", "priority", "department"]
    blocks = targets.filter("n > 0").select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _BLOCK))).alias("_block"))
    blocks = blocks.repartition(*combo, "_block")
    start = F.col("_block") * _BLOCK + 1
    items = blocks.select(*combo, F.explode(F.sequence(
        start, F.least(F.col("n"), start + (_BLOCK - 1)))).alias("item"))
    drawn = items.withColumn("_a", digest(F.concat_ws("|", *combo, F.col("item").cast("string")), seed, "topup"))
    return drawn.withColumns({
        "scenario": _scenario(F.col("category"), draw(F.col("_a"), 0)),
        "difficulty": weighted(draw(F.col("_a"), 1), fixed.DIFFICULTY_WEIGHTS),
    }).drop("_a")


def prompts(plan: DataFrame, topup: bool = False) -> DataFrame:
    """System and user prompt for each plan row; the instruction depends on the difficulty. A top-up
    prompt says that an unusual department is meant."""
    instruction = by_label(F.col("difficulty"), {d: F.lit(t) for d, t in fixed.DIFFICULTY_INSTRUCTIONS.items()})
    note = F.lit(fixed.TOPUP_DEPARTMENT_NOTE if topup else "")
    values = {"instruction": instruction, "department": F.concat("department", note)}
    parts = []
    rest = fixed.GENERATION_USER_PROMPT
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values.get(name, F.col(name))]
    parts.append(F.lit(rest))
    return plan.withColumns({"system_prompt": F.lit(fixed.GENERATION_SYSTEM_PROMPT),
                             "user_prompt": F.concat(*parts)})


def manifest(attempts: DataFrame, version: str, batch_id: str, seed: int) -> DataFrame:
    """One row about a generation run, from its attempts (column ``accepted``)."""
    counts = attempts.agg(F.count(F.lit(1)).alias("target_size"), F.count_if("accepted").alias("accepted"),
                          F.count_if(~F.col("accepted")).alias("rejected"))
    return counts.select(F.lit(version).alias("dataset_version"), F.lit(batch_id).alias("batch_id"),
                         F.lit(seed).cast("bigint").alias("seed"), "target_size", "accepted", "rejected")
