"""Wall seconds of the headline queries, as one line of JSON.

Each query is run once to warm up and then three times; the median counts.
Results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from jobtally.plans.queries import registered
from jobtally.session import local_session

HEADLINE = [
    "parse_job_stats",
    "merge_with_ops",
    "job_table",
    "group_by_user",
    "poll_summary",
    "rate_between_polls",
    "totals",
    "percent_of_total",
    "peak_ops",
    "peak_jobs",
    "top_jobs",
    "top_jobs_filtered",
    "top_job_bars",
    "filter_exclude",
    "op_series_rate",
    "series_rate",
    "latest_rate",
    "cap_series",
    "state_at",
    "replay_frames",
    "downsample",
    "prometheus_roundtrip",
]
RUNS = 3


def seconds(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "jobtally-bench", os.environ.get("BENCH_MEMORY", "16g"))
    queries = registered()
    timed = {}
    for name in HEADLINE:
        runs = [seconds(spark, queries[name], sf_dir) for _ in range(RUNS + 1)]
        timed[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
