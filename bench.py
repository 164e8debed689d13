"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed into the ``noop`` sink (all rows computed, none
collected). Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricelens.plans import load_all  # noqa: E402
from pricelens.session import ensure_checkpoint_dir, get_session  # noqa: E402

HEADLINE = [
    "a1_price_trends",          # price trend by days until event (the reference's rollup script)
    "w_all_features",           # all leakage-aware per-entity features
    "pipeline_model_table",     # clean -> split -> features -> label -> fill
    "w22_good_deal_label",
    "w24_temporal_split",
    "p14_iqr_filter",
    "a12_pivot_zone_days_bins",
    "a26_box_stats_top5",
    "u6_duplicates_all",
    "m7_metrics",
    "m9_roc_curve",
    "m10_best_threshold",
    "f15_savings_dashboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", 2 * cpus, app_name="pricelens-bench",
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    ensure_checkpoint_dir(spark)
    reg = load_all()
    # warm-up on the smallest tables (JIT and code generation), not on the timed data
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and warm_dir != sf_dir:
        for key in HEADLINE:
            reg[key].run(spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.perf_counter()
        reg[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
