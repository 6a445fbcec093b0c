"""Classification metrics, threshold sweep and latency profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import mean_of_scaled, percent, round_half_up
from .ordering import running_total

TASKS = {"category": fixed.CATEGORIES, "priority": fixed.PRIORITIES, "department": fixed.DEPARTMENTS}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _rows(wide: DataFrame, entries: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*entries)))


def accuracy(df: DataFrame) -> DataFrame:
    """Share of right labels per task, over all rows."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(f"true_{t}") == F.col(f"pred_{t}")).alias(t) for t in TASKS])
    return _rows(wide, [F.struct(F.lit(t).alias("task"), _ratio(F.col(t), F.col("n")).alias("accuracy"))
                        for t in TASKS])


def _class_counts(df: DataFrame) -> DataFrame:
    """Hits, predictions and true rows of every label of every task, as one row from one scan."""
    measures = []
    for task, labels in TASKS.items():
        true, pred = F.col(f"true_{task}"), F.col(f"pred_{task}")
        for i, label in enumerate(labels):
            measures += [F.count_if((true == label) & (pred == label)).alias(f"{task}_{i}_hit"),
                         F.count_if(pred == label).alias(f"{task}_{i}_pred"),
                         F.count_if(true == label).alias(f"{task}_{i}_true")]
    return df.agg(*measures)


def _scores(task: str, i: int) -> tuple[Column, Column, Column]:
    hit, pred, true = (F.col(f"{task}_{i}_{m}") for m in ("hit", "pred", "true"))
    return _ratio(hit, pred), _ratio(hit, true), _ratio(hit * 2, pred + true)


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per task and label; 0 where undefined."""
    entries = []
    for task, labels in TASKS.items():
        for i, label in enumerate(labels):
            precision, recall, f1 = _scores(task, i)
            entries.append(F.struct(
                F.lit(task).alias("task"), F.lit(label).alias("label"), precision.alias("precision"),
                recall.alias("recall"), f1.alias("f1"), F.col(f"{task}_{i}_true").alias("support")))
    return _rows(_class_counts(df), entries)


def macro_scores(df: DataFrame) -> DataFrame:
    """Unweighted means of the per-label scores over the fixed label lists."""
    entries = []
    for task, labels in TASKS.items():
        scores = [_scores(task, i) for i in range(len(labels))]
        means = [reduce(lambda a, b: a + b, column) / float(len(labels)) for column in zip(*scores)]
        names = ("macro_precision", "macro_recall", "macro_f1")
        entries.append(F.struct(F.lit(task).alias("task"), *[m.alias(n) for m, n in zip(means, names)]))
    return _rows(_class_counts(df), entries)


def confusion_matrix(df: DataFrame, task: str) -> DataFrame:
    """Rows: true label, columns: predicted labels, both in fixed order, zeros included."""
    labels = TASKS[task]
    true, pred = F.col(f"true_{task}"), F.col(f"pred_{task}")
    cells = {(i, j): F.count_if((true == t) & (pred == p)).alias(f"c{i}_{j}")
             for i, t in enumerate(labels) for j, p in enumerate(labels)}
    wide = df.agg(*cells.values())
    return _rows(wide, [F.struct(
        F.lit(t).alias("true_label"),
        *[F.col(f"c{i}_{j}").alias(f"pred_{p.lower().replace(' ', '_')}") for j, p in enumerate(labels)])
        for i, t in enumerate(labels)])


def critical_failures(df: DataFrame) -> DataFrame:
    """Critical tickets, those predicted Low or Medium, and the recall of Critical."""
    critical = F.col("true_priority") == "Critical"
    wide = df.agg(
        F.count_if(critical).alias("critical_total"),
        F.count_if(critical & F.col("pred_priority").isin("Low", "Medium")).alias("underestimated"),
        F.count_if(critical & (F.col("pred_priority") == "Critical")).alias("_hit"))
    return wide.select("critical_total", "underestimated",
                       _ratio(F.col("_hit"), F.col("critical_total")).alias("critical_recall"))


def validity_summary(df: DataFrame) -> DataFrame:
    """Size, share of valid outputs and mean confidence."""
    wide = df.agg(F.count(F.lit(1)).alias("tickets"), F.count_if("raw_valid").alias("valid"),
                  F.coalesce(F.sum(F.round(F.col("confidence") * 10000).cast("bigint")), F.lit(0)).alias("_s"))
    return wide.select("tickets", "valid", percent(F.col("valid"), F.col("tickets")).alias("valid_rate"),
                       mean_of_scaled(F.col("_s"), F.col("tickets"), 10000, 3).alias("avg_confidence"))


def threshold_sweep(df: DataFrame, thresholds: list[float] = fixed.SWEEP_THRESHOLDS) -> DataFrame:
    """Routing and accuracy at each confidence threshold, from one scan.

    All thresholds are measures of one aggregate, so rows are neither copied nor shuffled.
    """
    right = {t: F.col(f"true_{t}") == F.col(f"pred_{t}") for t in TASKS}
    full = reduce(lambda a, b: a & b, right.values())
    escaped = (F.col("true_priority") == "Critical") & (F.col("pred_priority") != "Critical")
    measures = [F.count(F.lit(1)).alias("n")]
    for i, threshold in enumerate(thresholds):
        auto = (F.col("confidence") >= F.lit(threshold)) & F.col("raw_valid")
        measures += [F.count_if(auto).alias(f"auto{i}"), F.count_if(auto & full).alias(f"full{i}"),
                     F.count_if(auto & escaped).alias(f"escaped{i}")]
        measures += [F.count_if(auto & ok).alias(f"{t}{i}") for t, ok in right.items()]
    entries = []
    n = F.col("n")
    for i, threshold in enumerate(thresholds):
        auto = F.col(f"auto{i}")
        entries.append(F.struct(
            F.lit(threshold).alias("threshold"), auto.alias("auto_routed_count"),
            (n - auto).alias("review_count"),
            (_ratio(auto, n) * 100).alias("auto_routing_rate"),
            (_ratio(n - auto, n) * 100).alias("review_rate"),
            (_ratio(F.col(f"category{i}"), auto) * 100).alias("auto_category_acc"),
            (_ratio(F.col(f"priority{i}"), auto) * 100).alias("auto_priority_acc"),
            (_ratio(F.col(f"department{i}"), auto) * 100).alias("auto_dept_acc"),
            (_ratio(F.col(f"full{i}"), auto) * 100).alias("auto_full_match_acc"),
            F.col(f"escaped{i}").alias("critical_errors_auto_routed")))
    return _rows(df.agg(*measures), entries)


def recommended_threshold(sweep: DataFrame) -> DataFrame:
    """Of the thresholds without critical escapes the one that routes most, lowest on ties; the
    highest threshold when none is free of escapes. The sweep has a handful of rows."""
    safe = F.col("critical_errors_auto_routed") == 0
    return sweep.orderBy(
        F.desc(safe), F.when(safe, F.col("auto_routing_rate")).desc(),
        F.when(safe, F.col("threshold")).asc(), F.desc("threshold")).limit(1)


def final_label_evaluation(df: DataFrame) -> DataFrame:
    """Accuracy of the final labels, routing and critical escapes of a labelled, triaged set."""
    n = F.col("total")
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.lower(f"final_{t}") == F.lower(F.col(t))).alias(t) for t in TASKS],
        F.count_if(F.col("routing_status") == "AUTO_ROUTED").alias("_auto"),
        F.count_if(_escape()).alias("critical_escapes"))
    return wide.select(
        "total", percent(F.col("category"), n, 2).alias("cat_acc"),
        percent(F.col("priority"), n, 2).alias("pri_acc"),
        percent(F.col("department"), n, 2).alias("dept_acc"),
        percent(F.col("_auto"), n, 2).alias("auto_rate"),
        (n - F.col("_auto")).alias("human_review_count"), "critical_escapes")


def _escape() -> Column:
    return ((F.col("priority") == "Critical") & F.col("final_priority").isin("Low", "Medium")
            & (F.col("routing_status") == "AUTO_ROUTED"))


def critical_escapes(df: DataFrame) -> DataFrame:
    """Truly critical tickets that were routed automatically with a low final priority."""
    return df.filter(_escape())


def latency_profile(df: DataFrame, value: str, quantiles: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Mean, exact quantiles with linear interpolation, and throughput per second.

    Equal values are counted first; running sums of the counts then tell which values sit around
    each quantile. No task sees more than its range of values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    placed = running_total(counts, "v", "c", "upto")
    total = F.lit(placed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    measures = []
    for i, q in enumerate(quantiles):
        at = (total - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        measures += [F.min(F.when(F.col("upto") > low, F.col("v"))).alias(f"low{i}"),
                     F.min(F.when(F.col("upto") > high, F.col("v"))).alias(f"high{i}")]
    wide = placed.agg(F.sum(F.col("v") * F.col("c")).alias("s"), F.sum("c").alias("n"), *measures)
    # The order of the sum may change the last bits, so the result has twelve significant digits.
    mean = F.when(F.col("n") > 0, F.format_string("%.11e", F.col("s") / F.col("n")).cast("double"))
    shown = [F.col("n").alias("samples"), mean.alias("mean_ms")]
    for i, q in enumerate(quantiles):
        at = (total - 1) * F.lit(q)
        part = at - F.floor(at)
        shown.append((F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * part)
                     .alias(f"p{round(q * 100)}_ms"))
    throughput = F.when(mean > 0, round_half_up(F.lit(1000.0) / mean, 1)).otherwise(F.lit(0.0))
    return wide.select(*shown, throughput.alias("throughput"))
