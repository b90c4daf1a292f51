"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores.  Each query runs once to warm up and is then timed; its whole result is
computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from callsift.session import build_session
from callsift.workload.queries import QUERIES

HEADLINE = (
    "endpoint_stats",
    "endpoint_top_n",
    "filter_requests",
    "hash_sample",
    "summary",
    "top_paths",
    "group_by_path_prefix",
    "latency_profile",
    "latency_profile_by_path",
    "latency_histogram",
    "pivot_method_status",
    "correlation_chains",
    "rate_limits",
    "normalize_requests",
    "redact_bodies",
    "truncate_bodies",
    "tag_requests",
    "score_requests",
    "inspect_requests",
    "validation_summary",
    "compare_sets",
    "snapshot_diff",
    "dedup_unique",
    "dedup_duplicates",
    "duplicate_groups",
    "merge_sources",
    "timeline_gaps",
    "throttle_kept",
    "throttle",
    "sort_requests",
    "paginate",
    "trim_newest",
    "replay_match",
    "retry_outcomes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "callsift-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 4)
    spark.stop()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
