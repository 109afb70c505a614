"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfcast.queries import QUERIES  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

HEADLINE = (
    "A1_weekly_demand",
    "W1_lags",
    "W3_rolling_std",
    "W4_ewma",
    "A3_last_known_metrics",
    "A5_daily_volatility",
    "A6_monthly_trend",
    "A12_regression_metrics",
    "J1_economic",
    "J5_supply_chain",
    "J9_new_rows",
    "J10_missing_dates",
    "J11_holidays_in_panel",
    "E1_external_features",
    "M2_combination_codes",
    "O2_positional_split",
    "R2_upload_audit",
    "F2_future_frame",
    "F3_bulk_report",
    "I_stock_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = build_session(
        "shelfcast-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["A4_daily_totals"](spark, sf_dir).count()  # start the JVM's compilers before the clock
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.split("sf")[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
