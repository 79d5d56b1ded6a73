"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores. Every
result is fully produced into a no-op sink, so nothing is pruned away.
``records_table`` is the one-off ingestion that writes the record table.
"""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "usage_totals",
    "last_response",
    "running_usage",
    "dedup_stats",
    "message_islands",
    "child_outcomes",
    "coverage_flags",
    "unknown_causes",
    "corpus_counts",
    "latest_token_count",
    "turn_summary",
    "turn_summary_b",
    "last_known",
    "status_episodes",
    "transitions",
    "classify_turn_role",
    "classify_text",
    "telemetry_view",
    "arrivals",
    "dominant_state",
    "liveness_gaps",
    "account_rows",
    "account_pace",
    "daily_usage",
    "predecessor_check",
    "path_category",
    "activity_windows",
    "activity_sessions",
    "read_session_log",
    "stream_usage",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sessionledger.catalog import QUERIES
    from sessionledger.fixtures import f1

    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times = {}
    start = time.time()
    f1(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["records_table"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
