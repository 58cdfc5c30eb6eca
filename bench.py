"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each query is run to its last
row through the no-op sink, once to warm the JVM up and BENCH_REPEATS times for the record; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cyclelens.catalog import QUERIES
from cyclelens.session import local_session

HEADLINE = (
    "issue_fact",
    "ai_impact",
    "team_metrics",
    "engineer_metrics_scored",
    "project_metrics",
    "category_metrics",
    "cross_dimensional",
    "timeline_adoption",
    "timeline_periods",
    "top_repositories",
    "ai_impact_base",
    "ai_impact_summary",
    "ai_impact_incremental",
    "cycle_time_summary",
    "refresh_all_metrics",
    "stream_on_stored_summary",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, cpus, "bench")
    times: dict[str, float] = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(min(seconds(spark, name, sf_dir) for _ in range(repeats)), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
