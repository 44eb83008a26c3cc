"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 1); the median counts.
Results are consumed in full but not brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spendlens.plans import registry
from spendlens.session import build_session

HEADLINE = [
    "platform_summary", "cross_platform", "period_comparison", "roas_trend", "dashboard_kpis", "channel_split",
    "top_campaigns", "upload_timeline", "trend_points", "period_pivot", "kpi_alerts", "anomalies", "account_forecast",
    "campaign_forecast", "audit_scores", "budget_actions", "client_benchmarks", "action_impact", "bulk_report",
    "clean_numeric", "normalize_dates", "clean_search_export", "funnel_by_campaign", "traffic_by_campaign",
    "rollup_adgroups", "keyword_insights", "report_sections", "style_scores", "detected_sources", "rolling_kpis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = registry.load()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            jobs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
