"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs once to warm up and then three
times, its result written nowhere; the least time counts.
"""

from __future__ import annotations

import json
import os
import time

from millrace import queries
from millrace.session import local_session

HEADLINE = (
    "kpi_sum kpi_batch ts_monthly_revenue cat_top_priority joined_revenue_by_nation joined_revenue_by_region seg_customer_activity "
    "left_join_zero_counts profile_counts profile_numeric profile_top5 profile_duplicates quality_scores clean_dedup rel_overlap wh_validate_orphans events_hourly"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
