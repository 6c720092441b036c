"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose the input
and the number of cores. Every query is timed in full: intermediate tables that queries share are
built anew for each of them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "as_of", "deterministic_ids", "upsert_dedupe", "quality_report", "multi_as_of",
    "latest_at_each_date", "price_panel", "ffill_returns", "price_features", "zscore_momentum",
    "top_fraction_momentum", "composite_top_k", "insider_net_buys", "opportunistic_net_buys",
    "event_clusters", "news_surges", "feature_matrix", "composite_score", "metrics_summary",
    "vol_target", "signal_ic", "car_distribution", "placebo", "grade_predictions", "fill_ledger",
    "order_plan", "knn_outcomes", "block_bootstrap",
]


def main() -> None:
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

    from pitline.plans import catalog
    from pitline.plans.registry import forget_shared
    from pitline.session import local_session

    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and the Python workers before the clock runs.
    catalog.QUERIES["fact_count"](spark, sf_dir).collect()
    times = {}
    for name in names:
        forget_shared()
        start = time.perf_counter()
        result = catalog.QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
