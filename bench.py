"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).

``triage_kpi`` reads uploaded tickets from parquet, cleans and triages them and computes the KPI
summary. The tickets are the projection of ``orders``, written once before the clock starts. All
other entries start from the benchmark tables and include the projection. Entries are warmed up once
and the median of a few runs is shown; near-duplicate removal runs once, cold.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ticketloom.operators import analytics, ingest, triage  # noqa: E402
from ticketloom.plans import queries as registry  # noqa: E402
from ticketloom.plans import tickets as data  # noqa: E402
from ticketloom.scratch import stored  # noqa: E402

_uploads = {}


def triage_kpi(spark, sf_dir):
    if sf_dir not in _uploads:
        _uploads[sf_dir] = stored(data.raw_tickets(spark, sf_dir), "uploads")
    triaged = triage.triage(ingest.clean_reviews(_uploads[sf_dir]))
    return analytics.summary_flat(triaged.withColumn("is_reviewed", F.lit(False)))



# name -> (query, timed runs after one warm-up; 0: a single run without warm-up)
HEADLINES = {
    "triage_kpi": (triage_kpi, 5),
    "triage_write": (registry.QUERIES["c11_triage"], 2),
    "review_state": (registry.QUERIES["d6_resolve"], 2),
    "review_queue": (registry.QUERIES["d5_review_queue"], 2),
    "all_trends": (registry.QUERIES["e11_all_trends"], 2),
    "validation": (registry.QUERIES["f8_totals"], 2),
    "threshold_sweep": (registry.QUERIES["h7_threshold_sweep"], 2),
    "token_confidence": (registry.QUERIES["c5_token_confidence"], 2),
    "latency_profile": (registry.QUERIES["h11_latency_profile"], 2),
    "scenario_plan": (registry.QUERIES["i1_scenario_plan"], 2),
    "stratified_split": (registry.QUERIES["g1_stratified_split"], 2),
    "shingles": (registry.QUERIES["f2_shingles"], 2),
    "near_dedup": (registry.QUERIES["f5_near_dedup"], 0),
    "leakage_removal": (registry.QUERIES["g3_leakage_removal"], 0),
}


def run(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    seconds = {}
    for name, (query, runs) in HEADLINES.items():
        if wanted and name not in wanted:
            continue
        if runs:
            run(query, spark, sf_dir)
        seconds[name] = round(statistics.median(run(query, spark, sf_dir) for _ in range(max(runs, 1))), 3)
    tickets = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    result = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }
    if "triage_kpi" in seconds:
        result["tickets_per_sec"] = round(tickets / seconds["triage_kpi"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
