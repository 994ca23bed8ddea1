"""Time the headline queries: one warm-up, then the median of the timed runs, full result computed.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the data, cores and runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from trialframe.plans import catalogue  # noqa: E402

HEADLINE = [
    "inhibition_summary",
    "sliced_and_pooled",
    "describe",
    "kruskal",
    "dunn_bh",
    "compact_letters",
    "summary_with_letters",
    "pairwise_ranksum",
    "anova_oneway",
    "levene",
    "anova_factorial",
    "shapiro_by_group",
    "outliers",
    "histogram",
    "to_long",
    "baseline_delta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        queries[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_median_query_time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
