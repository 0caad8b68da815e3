"""Stateful policies, sketches, incremental fits, mergeable samples and sweeps of open cells, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricewright.operators import clean, demand, incremental, learning, policies, sketches, stateful
from pricewright.params import EpisodeParams, FitParams, LearnParams
from pricewright.session import write_once
from pricewright.sources import catalogue as S
from pricewright.sources import versions

# --- stateful policies --------------------------------------------------------------


def counting():
    """Made inside a function, so that it travels to the tasks with its code."""

    class Counting:
        """Chooses the number of steps it has seen, and what the first one said."""

        def __init__(self):
            self.seen, self.first = 0, None

        def act(self, step):
            self.first = step["trend"] if self.first is None else self.first
            self.seen += 1
            return 100 * self.seen + int(self.first)

    return Counting


def test_policy_sees_one_episode_in_order(spark):
    rows = [(p, e, s, float(10 * e + s), "clash") for p in "ab" for e in range(3) for s in random.Random(p).sample(range(7), 7)]
    steps = spark.createDataFrame(rows, "product_id string, episode int, step int, trend double, action string").repartition(4)
    got = stateful.stateful_levels(steps, ["product_id", "episode"], "step", counting()).collect()
    assert len(got) == 42 and all(r.action == 100 * (r.step + 1) + 10 * r.episode for r in got)
    assert stateful.stateful_levels(steps.limit(0), ["product_id", "episode"], "step", counting()).collect() == []


def test_rule_as_policy_equals_the_fold(spark):
    draw = random.Random(2)
    rows = [("x", e, s, draw.uniform(-0.3, 0.3)) for e in range(4) for s in range(25)]
    steps = spark.createDataFrame(rows, "product_id string, episode int, step int, trend double")
    keys = ["product_id", "episode"]
    got = stateful.stateful_levels(steps, keys, "step", stateful.rule_policy(EpisodeParams(), "trend"))
    want = policies.rule_levels(steps, keys, "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*keys, "step", "action").collect()))


# --- sketches -----------------------------------------------------------------------


@pytest.mark.parametrize("tracked", [4096, 64])
def test_top_codes_from_sketches(spark, tracked):
    """Ties at the last place; many more codes than a small sketch can keep."""
    rows = [(f"{code}", day, 1.0) for code in range(400) for day in range(1, 4) for _ in range(30 - code // 8 if code < 160 else 1)]
    lines = spark.createDataFrame([(c, dt.date(2024, 1, d), q) for c, d, q in rows], "StockCode string, Date date, Quantity double")
    stored = write_once(sketches.daily_sketches(lines, tracked), "sketches")
    assert stored.count() == 3
    got = sketches.top_codes_of_days(stored, lines, 20, tracked).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in clean.top_codes(lines, 20).collect()]
    n = sketches.distinct_codes(stored).first()
    assert n.n_lines == len(rows) and abs(n.n_products - 400) < 20


def test_sketches_of_nothing(spark):
    lines = spark.createDataFrame([], "StockCode string, Date date, Quantity double")
    stored = write_once(sketches.daily_sketches(lines), "sketches")
    assert sketches.top_codes_of_days(stored, lines, 20).collect() == []


# --- incremental fits ---------------------------------------------------------------


def shop_days(seed):
    draw, rows = random.Random(seed), []
    for code, slope, n in (("a", -1.2, 300), ("b", -6.0, 200), ("flat", 0.0, 120), ("thin", -1.0, 20), ("wild", -0.5, 250), ("late", -2.0, 60)):
        for i in range(n):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i * 3 + (500 if code == "late" else 0))
            price = 5.0 if code == "flat" else 5 * draw.uniform(0.8, 1.25)
            qty = 100 * (price / 5) ** slope * draw.uniform(0.9, 1.1)
            if code == "wild" and i % 40 == 0:
                price, qty = price * 50, qty / 30  # beyond three deviations
            rows.append((code, day, price, 0.0 if i % 97 == 50 else qty))
    return rows


def test_three_batches_equal_one_fit(spark, tmp_path):
    rows = shop_days(5)
    daily = spark.createDataFrame(rows, "StockCode string, Date date, avg_price double, total_qty double")
    path, cuts = str(tmp_path / "state"), [dt.date(2000, 1, 1), dt.date(2020, 8, 15), dt.date(2021, 7, 1), dt.date(2030, 1, 1)]
    touched = []
    for begin, end in zip(cuts, cuts[1:]):
        touched.append(incremental.update_fits(daily.filter((F.col("Date") >= begin) & (F.col("Date") < end)), path)["products"])
    assert touched[0] == 5 and versions.current(spark, path)["number"] == 3
    usable = daily.filter("avg_price > 0 AND total_qty > 0")
    want = {r.StockCode: r for r in demand.fit_elasticity(demand.keep_dense_products(usable, 30)).collect()}
    got = {r.StockCode: r for r in incremental.current_fits(spark, path).collect()}
    assert set(got) == set(want) == {"a", "b", "flat", "wild", "late"}
    for code, w in want.items():
        g = got[code]
        assert (g.n_points, g.clipped) == (w.n_points, w.clipped)
        assert (g.elasticity, g.base_price, g.base_demand) == pytest.approx((w.elasticity, w.base_price, w.base_demand))


def test_only_torn_months_are_read_again(spark):
    daily = spark.createDataFrame(shop_days(6), "StockCode string, Date date, avg_price double, total_qty double")
    moments = incremental.monthly_moments(daily)
    # Without any days at hand, products all of whose months lie inside the bounds are still fitted.
    fits = {r.StockCode: r for r in incremental.fits_of(moments, daily.limit(0), FitParams(sigma=50.0)).collect()}
    want = {r.StockCode: r for r in demand.fit_elasticity(demand.keep_dense_products(daily.filter("total_qty > 0"), 30), FitParams(sigma=50.0)).collect()}
    assert {c: pytest.approx(f.elasticity) for c, f in fits.items()} == {c: w.elasticity for c, w in want.items()}


# --- samples and sweeps ---------------------------------------------------------------


def test_samples_merge(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("e"), F.lit(0).alias("s"))
    args = [F.col("k"), F.col("e"), F.col("s"), 40, 9]
    whole = learning.kept_samples(rows, ["k"], *args)
    kept = rows.limit(0)
    for part in range(4):
        kept = learning.kept_samples(kept.unionByName(rows.filter(F.col("e") % 4 == part)), ["k"], *args)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 120
    assert "WindowGroupLimit" in whole._jdf.queryExecution().executedPlan().toString()


def test_open_sweeps_equal_full_ones_and_settle(spark):
    draw = random.Random(12)
    # A chain: values move up it one state a sweep, and what lies behind settles.
    rows = [("p", s, a, draw.uniform(0, 1) if s == 9 else 0.0, s + 1 if s < 9 else 0, s == 9) for s in range(10) for a in range(2) for _ in range(3)]
    rows += [("lone", 0, 1, 2.0, 0, True)]
    frame = spark.createDataFrame(rows, "product_id string, state int, action int, reward double, next_state int, done boolean")
    learn = LearnParams(gamma=0.5)
    for n in (1, 2, 5):
        got, log = learning.converged_q(frame, ["product_id"], learn, tolerance=0.0, most=n)
        want = learning.fitted_q(frame, ["product_id"], n, learn)
        assert {tuple(r)[:3]: pytest.approx(r.q) for r in got.collect()} == {tuple(r)[:3]: r.q for r in want.collect()}
    _, log = learning.converged_q(frame, ["product_id"], learn, tolerance=1e-9)
    assert log[0][0] == 61 and all(n == 6 for n, _ in log[1:]) and len(log) <= 11
    q, log = learning.converged_q(frame, ["product_id"], learn, tolerance=0.01)
    assert log[-1][1] <= 0.5 and len(log) < 11 and q.count() == 21


def test_one_series_by_file_name(spark, tmp_path):
    days = [(i, dt.date(2023, 1, 1 + d), d, d + 1, 2.0, 5.0 + d, 10.0, 1.0) for i in ("7", "x+y", "a[1]") for d in range(3)]
    series = spark.createDataFrame(days, "product_id string, date date, day_of_week int, day_of_year int, price double, demand double, revenue double, seasonal double")
    S.write_series_csv(series, str(tmp_path / "s"))
    one = S.find_series_csv(spark, str(tmp_path / "s"), "x+y")
    assert one.count() == 3 and "PartitionFilters: [isnotnull(file" in one._jdf.queryExecution().executedPlan().toString()
    flat = tmp_path / "flat"
    flat.mkdir()
    for name in ("a[1]", "a1"):
        (flat / f"{name}_timeseries.csv").write_text("date,day_of_week,day_of_year,price,demand,revenue,seasonal\n2023-01-01,6,1,2.0,5,10.0,1.0\n")
    assert len(S.find_series_csv(spark, str(flat), "a[1]").inputFiles()) == 1
