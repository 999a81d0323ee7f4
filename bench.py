"""Time the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "w2_moving_average", "w4_percentile_rank", "w9_ema", "w13_smoothed_state", "t1_first_release",
    "t11_describe", "t12_covariance_correlation", "j4_asof_backward", "j4_asof_raw_rows", "g1_technical", "g3_index_breadth", "g4_dollar_index",
    "g6_oil", "g10_intermarket_ratio", "g14_index_derived", "g21_macro_payrolls", "g26_master_table",
    "g27_column_profile", "g28_imputation", "m1_purged_folds", "m11_label_scores", "m12_auc_per_class",
    "m14_entry_scores", "s14_upsert",
]


def main():
    from tidegauge.plans import catalog
    from tidegauge.session import build_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = sys.argv[1:] or HEADLINE
    queries["w2_moving_average"](spark, sf).write.format("noop").mode("overwrite").save()     # start the session
    times = {}
    for name in wanted:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
