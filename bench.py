"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
local cores. Results go to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from loadloom.plans.queries import QUERIES
from loadloom.session import local_session

HEADLINE = (
    "hourly_grid_by_user", "tariff_zone", "quality_report", "describe", "moments",
    "hour_weekday_pivot", "lags", "rolling", "feature_table", "lag_features", "seasonal_naive",
    "metrics_by_model", "leaderboard", "bias_correction", "backtest_summary",
    "residual_diagnostics", "ljung_box", "acf", "kpss", "adf", "decomposition", "cascade",
    "tariff_cost", "ensemble_fixed", "ensemble_search", "ridge",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the Python workers and the scan path before the clock runs.
    QUERIES["adf"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
