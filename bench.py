"""Time the headline queries: one warm-up, then the median of three runs of each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import platform
import statistics
import time

import pyspark

from srcpulse.plans.catalogue import QUERIES
from srcpulse.session import local_session

HEADLINE = (
    "high_risk_latest", "prediction_status", "trend_reference", "change_stats_90d", "change_stats_events",
    "line_profile_docs", "style_issues", "gate_report", "check_changes", "import_stats", "knn_patterns", "decay_scores",
    "repo_report", "source_url_triage", "stream_churn",
)
RUNS = 3


def once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", RUNS))
    spark = local_session("srcpulse-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        once(spark, name, sf_dir)
        times[name] = round(statistics.median(once(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores, "spark": pyspark.__version__,
                "python": platform.python_version(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
