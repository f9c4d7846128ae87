"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the local cores. Every query runs once to warm up and then once more,
which counts. Each run writes the whole result to a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from sumtrail.session import local_session

HEADLINE = [
    "monthly_series_by_region", "anomalies", "breakdown_by_region", "concentration_by_region", "histogram",
    "numeric_summary", "correlations", "category_frequencies", "value_bands", "forecast_per_customer",
    "customer_segments_by_region", "churn_exposure", "health_by_region", "actions_by_region", "customer_counts",
    "dependency_risk", "duplicate_rows", "profile_columns", "clean_rows", "stock_coverage", "scenario_grid",
    "profile_catalog", "column_roles", "key_overlap", "relations", "connected_metrics",
]
#: Timed runs after a first one; queries that take long are timed once.
RUNS, LONG = 3, 15.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if len(times) == 2 and times[1] > LONG:
                break
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
