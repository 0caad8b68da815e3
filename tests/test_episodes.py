"""Logged episodes against a hand-made series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricewright.operators import episodes, evaluate
from pricewright.params import EpisodeParams

PARAMS = EpisodeParams(episode_len=10, max_inventory=40, restock=20)
N_DAYS = 47


@pytest.fixture(scope="module")
def steps(spark):
    figures = "product_id string, base_price double, price_min double, price_max double, elasticity double, base_demand double"
    catalogue = spark.createDataFrame([("7", 2.0, 1.0, 4.0, -1.0, 10.0)], figures)
    days = [("7", dt.date(2023, 1, 1) + dt.timedelta(days=d), 1.0 + 0.3 * (d % 11), float(5 + d)) for d in range(N_DAYS)]
    series = spark.createDataFrame(days, "product_id string, date date, price double, demand double")
    return episodes.logged_steps(catalogue, series, PARAMS).collect()


def test_steps_are_the_logged_days(steps):
    stock, booked = PARAMS.max_inventory, []
    for d in range(N_DAYS):
        sold = min(5 + d, stock)
        booked.append((stock, sold, 5 + d - sold))
        stock = min(PARAMS.max_inventory, stock - sold + PARAMS.restock)
    assert sorted(r["start"] + r["step"] for r in steps) == list(range(N_DAYS))
    assert max(r["step"] for r in steps if r["episode"] == 4) == 6
    for r in steps:
        d = r["start"] + r["step"]
        assert (r["inventory_before"], r["units_sold"], r["lost_units"]) == booked[d]
        assert r["price"] == pytest.approx(1.0 + 0.3 * (d % 11)) and r["action"] == d % 11 and r["demand"] == 5 + d
        raw = r["units_sold"] * r["price"] - 2 * r["lost_units"] - 0.001 * r["inventory_before"]
        assert r["reward"] == pytest.approx(raw / 20)
        assert r["next_day_of_year"] == min(d + 1, N_DAYS - 1) + 1
        begun = r["start"] % 11
        assert r["policy"] == ("below_list" if begun < 3 else "above_list" if begun > 3 else "at_list")


def test_histories_begin_with_the_base_figures(steps):
    for r in (r for r in steps if r["step"] == 0):
        assert r["trend_before"] == pytest.approx(0, abs=1e-6) and r["oldest_price"] == 2.0
        assert r["trend"] == pytest.approx((6 * 10 + r["units_sold"]) / 70 - 1)


def test_halves_share_no_day(spark, steps):
    rows = spark.createDataFrame(steps)
    early, late = episodes.earlier(rows), episodes.later(rows)
    days = [{r["start"] + r["step"] for r in half.select("start", "step").collect()} for half in (early, late)]
    assert days == [set(range(23)), set(range(23, N_DAYS))]
    lone = rows.filter("start + step = 0").withColumn("n_rows", F.lit(1))
    assert episodes.earlier(lone).count() == 0 and episodes.later(lone).count() == 1


def test_all_logged_days_and_products_are_evaluated(spark):
    from pricewright import plans
    from pricewright.plans import base

    sf_dir = "/root/testdata/sf0.01"
    steps = plans.QUERIES["logged_episode_steps"](spark, sf_dir)
    days = base.series(spark, sf_dir)
    assert steps.select("product_id", F.col("start") + F.col("step")).distinct().count() == steps.count() == days.count()
    judged = plans.QUERIES["learned_policy_evaluation"](spark, sf_dir).collect()
    assert len(judged) == days.select("product_id").distinct().count()
    assert len({r.product_id for r in plans.QUERIES["adaptation_curve"](spark, sf_dir).collect()}) == len(judged)


def test_priced_series_has_the_figures_of_the_catalogue(spark):
    from pricewright.operators import demand
    from pricewright.plans import base

    sf_dir = "/root/testdata/sf0.01"
    lines = base.cleaned(spark, sf_dir)
    priced = demand.priced_series(demand.daily_demand(lines))
    wanted = demand.product_series(demand.daily_demand(lines)).join(demand.elasticity_catalogue(lines), "product_id")
    columns = sorted(wanted.columns)
    assert sorted(priced.columns) == columns
    near = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(wanted.dtypes)]
    assert priced.select(near).exceptAll(wanted.select(near)).count() == 0 and priced.count() == wanted.count()


def test_matched_evaluation(spark):
    steps = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 0, 2, 4.0), ("a", 1, 5, 6.0), ("b", 0, 0, 1.0)], "product_id string, state int, action int, reward double")
    best = spark.createDataFrame([("a", 0, 2)], "product_id string, state int, action int")
    got = {r["product_id"]: tuple(r)[1:] for r in evaluate.matched_evaluation(steps, best, ["product_id"]).collect()}
    assert got == {"a": (3, 2, 5.0, 4.0), "b": (1, 0, None, 1.0)}


def test_totals_of_a_log(spark, steps):
    rows = spark.createDataFrame(steps)
    total = evaluate.episode_totals(rows).agg(F.sum("total_reward"), F.sum("n_steps")).first()
    assert total[0] == pytest.approx(sum(r["reward"] for r in steps)) and total[1] == len(steps)


@pytest.mark.parametrize("name", ["line_steps_with_calendar_rows", "steps_with_calendar_rows"])
def test_steps_reach_all_products_and_whole_calendars(spark, name):
    from pricewright import plans
    from pricewright.plans import base

    sf_dir = "/root/testdata/sf0.01"
    steps = plans.QUERIES[name](spark, sf_dir)
    ends = F.min("row_index").alias("low"), F.max("row_index").alias("high")
    got = {r.product_id: (r.low, r.high) for r in steps.groupBy("product_id").agg(*ends).collect()}
    rows = {r.product_id: r.n for r in base.series(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    assert len(rows) > 10 and set(got) == set(rows)
    # Starts come from all over the calendar, and every product has steps that the end of it holds back.
    assert all(got[p][0] < 0.2 * n and got[p][1] == n - 1 for p, n in rows.items())
