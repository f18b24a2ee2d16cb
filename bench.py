"""Bench: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is executed in full with the no-op sink (every row produced,
nothing collected to the driver).  Every query first runs once on the small
sf0.01 corpus so one-time JVM start-up, code generation and Python worker
launch are not charged to whichever query happens to run first; no data or
result is cached between the two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from almanac.session import build_session  # noqa: E402
from almanac.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "outcomes", "proximity_match", "keyword_hits_simple", "page_fields", "page_links",
    "latest_per_key", "faceted_search", "dashboard_counts", "year_buckets", "location_groups",
    "death_date_text", "paragraphs", "dedup_by_text", "stop_at_stale", "repeated_pages",
    "resume_slice", "run_counters", "latest_state", "attempts", "csv_rows", "tag_updates",
    "listing_plan_work", "search_plan_work", "stream_counters",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app="almanac-bench")
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
