"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores and
BENCH_QUERIES a comma-separated choice. Every query runs to the end and writes all its rows
nowhere (the ``noop`` sink). It is timed on its second run, plan building included: the first
one compiles its generated code, which does not grow with the data.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "query_day_slices",
    "enriched_query_history",
    "enriched_query_history_hourly",
    "labeled_query_history",
    "predefined_labels",
    "query_fingerprint",
    "sessions",
    "warehouse_sessions_hourly",
    "warehouse_daily_utilization",
    "warehouse_hourly_utilization",
    "report_top_spenders",
    "report_query_activity",
    "report_recurring_share",
    "report_top_repeated_by_cost",
    "report_weekly_heatmap",
    "report_session_gaps",
    "report_dbt_trend",
    "users_per_warehouse_day",
    "hourly_quota",
    "probe_new_matches",
    "usage_by_schedule_slot",
    "materialization_status",
    "task_log_close_stale",
    "incr_refresh",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")

    from meterlight import build_session
    from meterlight.plans import catalog

    spark = build_session(
        "meterlight-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = chosen.split(",") if chosen else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
