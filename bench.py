"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS``
the timed runs per query (their median counts; one run before is a warm-up).
``BENCH_QUERIES=all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from clustervitals.plans.queries import BUILDS, run

HEADLINE = [
    "skew_check", "skew_from_files", "schema_size", "top_append_only", "top_indexes", "relation_files",
    "heap_bloat", "ao_bloat", "default_partition_rows", "changed_tables", "stale_stats", "high_age_relations",
    "high_age_auxiliary", "session_metrics", "lock_waits", "longest_lock_wait", "orphan_temp_schemas",
    "terminated_without_panic", "session_log_tail", "process_log_tail", "pattern_counts", "latest_metrics",
    "table_privileges", "health", "stream_log_alerts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(BUILDS) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    )
    log_dir = os.environ.get("BENCH_EVENT_LOG")
    if log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir).config(
            "spark.eventLog.compress", "false"
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    timings = {}
    for name in names:
        spark.sparkContext.setJobDescription(name)
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
