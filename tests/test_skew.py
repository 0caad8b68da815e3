"""One product holds a third of all rows: results against brute force, and plan shapes."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from pricewright import plans
from pricewright.operators import clean, demand
from pricewright.operators import learning as L

DAYS = 60


# Daily totals that lie exactly on quantity = 1000 * price ** slope, so the slope is known without a fit.
SLOPES = {"hot": -1.7, "a": -0.8, "b": -3.1}


@pytest.fixture(scope="module")
def lines():
    rows = []
    for code, slope in SLOPES.items():
        pieces = 40 if code == "hot" else 7
        for day in range(DAYS):
            price = 2.0 + day % 6
            at = dt.datetime(2023, 1, 1) + dt.timedelta(days=day)
            rows += [("1", code, 1000 * price**slope / pieces, price, at)] * pieces
            rows.append(("C1", code, 5.0, 99.0, at))
    return pd.DataFrame(rows, columns=["Invoice", "StockCode", "Quantity", "Price", "InvoiceDate"])


def test_fit_with_a_hot_product(spark, lines):
    df = spark.createDataFrame(lines).repartition(16)
    daily = demand.keep_dense_products(demand.daily_demand(clean.clean_rows(df)), 30)
    got = {r["StockCode"]: r for r in demand.fit_elasticity(daily).collect()}
    assert got.keys() == SLOPES.keys()
    for code, slope in SLOPES.items():
        assert got[code]["elasticity"] == pytest.approx(slope)
        assert got[code]["base_price"] == pytest.approx(4.5)
        assert got[code]["base_demand"] == pytest.approx(sum(1000 * p**slope for p in range(2, 8)) / 6)


def test_lines_are_combined_before_the_shuffle(spark, lines):
    df = spark.createDataFrame(lines).repartition(4)
    plan = demand.daily_demand(clean.clean_rows(df))._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("partial_avg"), plan.index("Exchange hashpartitioning(StockCode")
    assert exchange < partial  # plans print the top first: the partial aggregate is below the exchange


def test_hot_product_in_a_sweep(spark):
    """Targets of a product with most of the transitions, against a plain loop."""
    rng = np.random.default_rng(3)
    n = 3000
    rows = [(("hot" if rng.random() < 0.7 else str(rng.integers(0, 5))), int(rng.integers(0, 12)), int(rng.integers(0, 11)),
             float(rng.normal(1, 30)), int(rng.integers(0, 12)), bool(rng.random() < 0.1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "product_id string, state int, action int, reward double, next_state int, done boolean")
    got = {(r["product_id"], r["state"], r["action"]): r["q"] for r in L.fitted_q(df, ["product_id"], sweeps=3).collect()}
    q = {}
    for _ in range(3):
        best = {}
        for (p, s, _a), v in q.items():
            best[p, s] = max(best.get((p, s), v), v)
        cells = {}
        for p, s, a, r, s2, done in rows:
            target = r + 0.99 * best.get((p, s2), 0.0) * (0.0 if done else 1.0)
            cells.setdefault((p, s, a), []).append(min(50.0, max(-50.0, target)))
        q = {k: sum(v) / len(v) for k, v in cells.items()}
    assert got.keys() == q.keys()
    assert all(got[k] == pytest.approx(q[k]) for k in q)


# Queries with one step in a single task, and why it sees only few rows.
SINGLE_TASK = {"clean_table_report": "one row", "policy_leaderboard": "one row per policy"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan_shapes(spark, small_dir, name):
    """No product of two tables and no row-at-a-time Python, without broadcasts to hide behind."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BatchEvalPython", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_headline_plans_gather_few_rows(spark, small_dir):
    for name in ("logged_episode_steps", "price_elasticity", "ten_feature_table", "stock_ledger", "demand_curve", "catalogue_with_series",
                 "expected_series", "policy_leaderboard", "clean_table_report"):
        plan = plans.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan or name in SINGLE_TASK, name


def test_scan_reads_only_what_is_needed(spark, small_dir):
    plan = plans.QUERIES["daily_product_demand"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "l_discount" not in scan and "l_tax" not in scan and "GreaterThan(l_quantity,0.0)" in scan


@pytest.mark.parametrize(
    "name", ["demand_trend", "price_momentum", "previous_price", "clipped_price_walk", "logged_episode_steps", "policy_leaderboard", "ten_feature_table_of_log"]
)
def test_lines_are_scanned_once(spark, small_dir, name):
    plan = plans.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
