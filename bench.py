"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
import warnings

from pricewright import plans
from pricewright.session import build_session

HEADLINES = (
    "clean_transaction_table",
    "daily_product_demand",
    "price_elasticity",
    "fitted_product_catalogue",
    "expected_series",
    "demand_trend",
    "smoothed_learning_curve",
    "stock_ledger",
    "logged_episode_steps",
    "ten_feature_table",
    "policy_leaderboard",
    "fitted_q_per_product",
    "adapted_q_per_product",
    "streamed_daily_demand",
)


def timed(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    warnings.filterwarnings("ignore")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    plans.QUERIES["reward_scale"](spark, sf_dir).count()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINES:
        # The first run also compiles; the middle one of three counts.
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
