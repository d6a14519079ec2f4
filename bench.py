"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from catalog import QUERIES
from shelfcast.session import local_session

HEADLINE = (
    "sales_panel", "sales_panel_by_brand", "gap_fill", "dedup_first", "iqr_cap", "outlier_stats", "rolling_stats", "ema",
    "leakage_safe", "price_features", "promo_runs", "weather_temp", "holiday_distance", "feature_table",
    "all_baselines", "backtest_baselines", "champion", "inventory", "data_drift", "scoring_features", "gbt_forecast",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["date_range"](spark, folder).collect()  # start the session before the clock does
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
