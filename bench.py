"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then timed; the median of the timed runs counts. A run
covers building the plan and executing it completely (no-op sink). Beside that, ``parts`` gives the medians of
building the DataFrame, planning it and executing it, and ``shuffled`` one run with broadcast joins
switched off, as with tables that are too large for them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks.registry import QUERIES

HEADLINE = (
    "net_flows_by_country", "net_flows_report", "historical_inflows", "debt_service",
    "inflow_scenarios", "oda_scenarios", "all_flows", "prep_flows", "gdp_index", "chart_6",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fluxbook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(spark: SparkSession, folder: str, key: str) -> dict[str, float]:
    """Seconds of building and executing, and of planning, which the execution contains."""
    start = time.perf_counter()
    df = QUERIES[key](spark, folder)
    built = time.perf_counter()
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    done = time.perf_counter()
    plan = planned - built
    return {"build": built - start, "plan": plan, "run": max(done - planned - plan, 0.0), "total": built - start + done - planned}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds, parts, shuffled = {}, {}, {}
    for key in HEADLINE:
        timed(spark, folder, key)
        runs = [timed(spark, folder, key) for _ in range(RUNS)]
        middle = {part: round(statistics.median(r[part] for r in runs), 3) for part in runs[0]}
        seconds[key] = middle.pop("total")
        parts[key] = middle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    for key in HEADLINE:
        shuffled[key] = round(timed(spark, folder, key)["total"], 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "parts": parts,
        "shuffled": shuffled,
    }))


if __name__ == "__main__":
    main()
