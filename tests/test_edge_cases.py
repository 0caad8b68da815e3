"""Literal cases: cleaning, fitting, scalar formulas, windows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.functions import pricing as P
from pricewright.functions.numbers import HASH_RANGE, half_up, mixed_hash, mixed_unit
from pricewright.operators import clean, demand, ledger, policies, windows
from pricewright.operators import learning as L
from pricewright.operators.calendar import attach_calendar
from pricewright.operators.catalogue import add_custom_products, first_products, overlay_fitted
from pricewright.operators.positions import with_position
from pricewright.params import EpisodeParams, FitParams

DAY0 = dt.date(2023, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


RAW = "Invoice string, StockCode string, Quantity string, Price string, InvoiceDate string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_only_upper_case_c_is_cancelled(spark):
    rows = raw(spark, [(i, "a", "1", "1", "2023-01-01") for i in ("C536379", "c1", "536365", None)])
    assert {r["Invoice"] for r in clean.drop_cancelled(rows).collect()} == {"c1", "536365", None}


def test_bad_numbers_and_dates_are_dropped(spark):
    rows = raw(spark, [
        ("1", "a", "2", "3.5", "2023-01-01 10:00:00"),
        ("2", "a", "abc", "3.5", "2023-01-01"),
        ("3", "a", "2", "", "2023-01-01"),
        ("4", "a", "2", "3.5", "bad"),
        ("5", "a", "2", "NaN", "2023-01-01"),
        ("6", "a", "-2", "3.5", "2023-01-01"),
        ("7", None, "2", "3.5", "2023-01-01"),
        ("8", "a", "2", "3.5", "1/12/2010 8:26"),
        ("9", "a", "2", "3.5", "2023-01-02T09:30:00"),
    ])
    kept = {r["Invoice"]: r["Date"] for r in clean.clean_rows(rows).collect()}
    assert kept == {"1": DAY0, "8": dt.date(2010, 1, 12), "9": dt.date(2023, 1, 2)}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="Price"):
        clean.clean_rows(raw(spark, [("1", "a", "1", "1", "2023-01-01")]).drop("Price"))


def test_rank_ties_go_to_the_lowest_codes(spark):
    rows = spark.createDataFrame([(c, 1.0) for c in ("9000", "22423", "85123A", "100")], "StockCode string, Quantity double")
    assert [r["StockCode"] for r in clean.top_codes(rows, 2).collect()] == ["100", "9000"]


def test_numeric_codes_come_first(spark):
    codes = spark.createDataFrame([("85123A",), ("22423",), ("9000",)], "product_id string")
    assert [r["product_id"] for r in first_products(codes, 3).collect()] == ["9000", "22423", "85123A"]


def series(spark, prices, quantities, code="a"):
    rows = [(code, DAY0 + dt.timedelta(days=i), float(p), float(q)) for i, (p, q) in enumerate(zip(prices, quantities))]
    return spark.createDataFrame(rows, "StockCode string, Date date, avg_price double, total_qty double")


def fit(spark, prices, quantities):
    return demand.fit_elasticity(series(spark, prices, quantities)).first()


def test_short_series_falls_back(spark):
    row = fit(spark, [1, 2, 3, 1, 2, 3, 1, 2, 3], [9, 5, 3, 9, 5, 3, 9, 5, 4])
    assert row["elasticity"] == -1.5 and row["base_price"] == 2.0 and not row["clipped"]


def test_constant_price_gives_the_upper_bound(spark):
    row = fit(spark, [0.1] * 30, range(1, 31))
    assert row["elasticity"] == -0.1 and row["base_demand"] == 15.5


def test_constant_quantity_gives_the_upper_bound(spark):
    assert fit(spark, range(1, 31), [7] * 30)["elasticity"] == -0.1


def test_positive_slope_is_clipped(spark):
    row = fit(spark, range(1, 31), range(1, 31))
    assert row["elasticity"] == -0.1 and row["clipped"]


def test_steep_slope_is_clipped(spark):
    prices = [1 + i / 30 for i in range(30)]
    row = fit(spark, prices, [p**-9 for p in prices])
    assert row["elasticity"] == -5.0 and row["clipped"]


def test_outlier_is_left_out_of_the_slope_but_not_of_the_means(spark):
    prices = [1 + (i % 7) / 10 for i in range(60)]
    quantities = [100 * p**-2 for p in prices]
    clean_slope = fit(spark, prices, quantities)["elasticity"]
    assert clean_slope == pytest.approx(-2.0)
    quantities[30] *= 100
    row = fit(spark, prices, quantities)
    assert row["elasticity"] == pytest.approx(-2.0)
    assert row["base_demand"] == pytest.approx(sum(quantities) / 60)


def test_days_below_the_minimum_drop_the_product(spark):
    daily = series(spark, [1.0] * 29, [1.0] * 29).unionByName(series(spark, [1.0] * 30, [1.0] * 30, "b"))
    kept = demand.keep_dense_products(daily, FitParams().min_days)
    assert {r["StockCode"] for r in kept.select("StockCode").distinct().collect()} == {"b"}


def test_daily_price_is_not_weighted(spark):
    rows = spark.createDataFrame([("a", DAY0, 1.0, 99.0), ("a", DAY0, 3.0, 1.0)], "StockCode string, Date date, Price double, Quantity double")
    row = demand.daily_demand(rows).first()
    assert (row["avg_price"], row["total_qty"]) == (2.0, 100.0)


GOLDEN = [
    # id, base, low, high, demand, elasticity, scale, fixed, fixed price, optimal raw, optimal, optimal price
    ("20725", 1.98, 0.99, 3.96, 70.4, -0.587, 139.392, 3, 1.881, 2.97, 7, 3.069),
    ("20727", 1.95, 0.97, 3.89, 50.5, -0.102, 98.475, 3, 1.846, 2.925, 7, 3.014),
    ("21212", 0.67, 0.33, 1.34, None, -1.123, 132.526, 3, 0.633, 6.1172, 10, 1.34),
]


@pytest.mark.parametrize("row", GOLDEN, ids=lambda r: r[0])
def test_golden_levels(spark, row):
    _, base, low, high, quantity, elasticity, scale, fixed, fixed_price, raw_best, best, best_price = row
    grid = P.price_grid(F.lit(low), F.lit(high))
    assert one(spark, P.nearest_level(grid, F.lit(base))) == fixed
    assert one(spark, grid[fixed]) == pytest.approx(fixed_price, abs=6e-4)
    optimal = P.revenue_maximising_price(F.lit(base), F.lit(elasticity))
    assert one(spark, optimal) == pytest.approx(raw_best, abs=5e-5)
    kept = F.greatest(F.lit(low), F.least(F.lit(high), optimal))
    assert one(spark, P.nearest_level(grid, kept)) == best
    assert one(spark, grid[best]) == pytest.approx(best_price, abs=6e-4)
    if quantity:
        assert one(spark, P.reward_scale(F.lit(quantity), F.lit(base))) == pytest.approx(scale)


def test_nearest_level_tie_takes_the_lower(spark):
    grid = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, P.nearest_level(grid, F.lit(2.5))) == 1


def test_scalar_literals(spark):
    assert one(spark, P.huber(F.lit(0.5))) == 0.125
    assert one(spark, P.huber(F.lit(2.0))) == 1.5
    assert one(spark, P.td_target(F.lit(1.0), F.lit(10.0), F.lit(False))) == pytest.approx(10.9)
    assert one(spark, P.td_target(F.lit(1.0), F.lit(10.0), F.lit(True))) == 1.0
    assert one(spark, P.td_target(F.lit(1.0), F.lit(90.0), F.lit(False))) == 50.0
    assert one(spark, P.day_of_week(F.lit("2023-01-01").cast("date"))) == 6
    assert one(spark, P.day_of_year(F.lit("2024-12-31").cast("date"))) == 366
    assert one(spark, P.product_code(F.lit(7))) == "P007"
    assert one(spark, half_up(F.lit(0.125), 2)) == 0.13
    assert one(spark, P.units_sold(F.lit(9.99), F.lit(40))) == 9
    assert one(spark, P.geometric_epsilon(F.lit(10_000))) == 0.05
    assert one(spark, P.linear_epsilon(F.lit(2), 0.05)) == pytest.approx(0.2)


@pytest.mark.parametrize("category, index", [
    ("Electronics", 0), ("Physical Good", 0), ("Subscription", 1), ("Home & Garden Service", 2), ("DIGITAL goods", 3), ("perishable", 4),
])
def test_category_index(spark, category, index):
    assert one(spark, P.category_index(F.lit(category))) == index


def ledger_of(spark, demands, params, start, segment=30):
    days = spark.createDataFrame([("a", i, float(d), 2.0) for i, d in enumerate(demands)], "product_id string, day int, demand double, price double")
    rows = ledger.stock_ledger(days, ["product_id"], "day", params, start, segment)
    return sorted(rows.collect(), key=lambda r: r["day"])


def test_inventory_ledger(spark):
    rows = ledger_of(spark, [30, 900, 10], EpisodeParams(), 1000)
    assert [r["inventory"] for r in rows] == [1020, 170, 210]
    assert [r["lost_units"] for r in rows] == [0, 0, 0]


def test_sell_out(spark):
    row = ledger_of(spark, [60], EpisodeParams(restock=15), 40)[0]
    assert (row["units_sold"], row["lost_units"], row["inventory"]) == (40, 20, 15)
    assert row["raw_reward"] == pytest.approx(40 * 2.0 - 2.0 * 20 - 0.001 * 40)


def test_ledger_does_not_depend_on_the_segment_length(spark):
    demands = [(i * 37) % 83 for i in range(100)]
    params = EpisodeParams(max_inventory=60, restock=30)
    runs = [[(r["step"], r["units_sold"], r["inventory"]) for r in ledger_of(spark, demands, params, 60, s)] for s in (1, 7, 30, 500)]
    stock, expected = 60, []
    for i, d in enumerate(demands):
        sold = min(d, stock)
        stock = min(60, max(0, stock - sold) + 30)
        expected.append((i, sold, stock))
    assert all(run == expected for run in runs)


def test_demand_trend_starts_from_a_full_history(spark):
    rows = spark.createDataFrame([("a", 0, 24, 10.0)], "k string, t int, units_sold int, base_demand double")
    assert windows.demand_trend(rows, ["k"], "t").first()["demand_trend"] == pytest.approx(0.2, abs=1e-8)


def test_momentum_starts_from_the_base_price(spark):
    rows = spark.createDataFrame([("a", i, p, 2.0) for i, p in enumerate([3.0, 4.0, 5.0])], "k string, t int, price double, base_price double")
    out = windows.price_momentum(rows, ["k"], "t").orderBy("t").collect()
    assert [r["price_momentum"] for r in out] == pytest.approx([0.5, 1.0, 1.0], abs=1e-7)


def test_rule_is_clamped_at_every_step(spark):
    trends = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.5] * 7 + [-0.5])], "k string, step int, trend double")
    out = policies.rule_levels(trends, ["k"], "step").orderBy("step").collect()
    assert [r["action"] for r in out] == [6, 7, 8, 9, 10, 10, 10, 9]


def test_calendar_index_is_clamped(spark):
    days = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i)) for i in range(5)], "product_id string, date date")
    steps = spark.createDataFrame([("a", 3, o) for o in range(4)], "product_id string, start int, offset int")
    out = attach_calendar(steps, days).orderBy("offset").collect()
    assert [r["date"].day for r in out] == [4, 5, 5, 5]


def test_short_curve_is_not_smoothed(spark):
    curve = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, position bigint, value double")
    out = windows.moving_average(curve, ["k"], "position", "value", 20).orderBy("position").collect()
    assert [r["smoothed"] for r in out] == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("block", [20, 21, 64, 1000])
def test_moving_average_is_the_same_for_all_block_sizes(spark, block):
    values = [math.sin(i) for i in range(205)]
    curve = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, position bigint, value double")
    out = windows.moving_average(curve, ["k"], "position", "value", 20, block).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(19, 205))
    assert [r["smoothed"] for r in out] == pytest.approx([sum(values[i - 19 : i + 1]) / 20 for i in range(19, 205)])
    assert out[0]["x"] == 10


def test_newest_rows_of_a_hot_key(spark):
    hot = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    cold = spark.range(30).select(F.lit("cold").alias("k"), (F.col("id") * 1000).alias("seq"))
    out = windows.newest_rows(hot.unionByName(cold), ["k"], "seq", 70)
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append(r["seq"])
    assert sorted(got["hot"]) == list(range(4930, 5000))
    assert len(got["cold"]) == 30


def test_positions_are_dense_over_many_partitions(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    out = with_position(df, [F.col("v").asc()]).collect()
    assert sorted((r["v"], r["position"]) for r in out) == [(i, i + 1) for i in range(1000)]


def test_overlay_keeps_surplus_templates_and_drops_surplus_fits(spark):
    fields = "product_id string, base_price double, elasticity double, base_demand double, price_min double, price_max double"
    templates = spark.createDataFrame([(f"P{i:03d}", "n", 1.0, -1.0, 1.0, 0.5, 2.0) for i in range(3)], fields.replace("string,", "string, name string,", 1))
    fits = spark.createDataFrame([(c, 9.0, -2.0, 9.0, 4.5, 18.0) for c in ("85123A", "9000")], fields)
    out = overlay_fitted(templates, fits).orderBy("position").collect()
    assert [(r["product_id"], r["base_price"], r["name"]) for r in out] == [("9000", 9.0, "n"), ("85123A", 9.0, "n"), ("P002", 1.0, "n")]
    many = spark.createDataFrame([(str(i), 9.0, -2.0, 9.0, 4.5, 18.0) for i in range(9)], fields)
    assert overlay_fitted(templates, many).count() == 3


def test_custom_ids_go_on_after_the_taken_ones(spark):
    products = spark.createDataFrame([("P000", "a"), ("99000", "b"), ("12", "c")], "product_id string, name string")
    custom = spark.createDataFrame([("x", "service", 10.0, -0.5, 50.0, 0), ("y", "digital", 3.0, -0.5, 50.0, 1)],
                                   "name string, category string, base_price double, elasticity double, base_demand double, request_no int")
    out = {r["product_id"]: r for r in add_custom_products(products, custom).collect()}
    assert set(out) == {"P000", "99000", "12", "99001", "99002"}
    assert out["99002"]["price_min"] == 1.5 and out["99001"]["is_custom"] and out["12"]["is_custom"] is None


def test_minibatch_waits_for_enough_rows(spark):
    few = spark.range(127).select("id")
    args = (F.col("id"), F.lit(0), F.lit(0))
    assert L.minibatch(few, *args, size=128).count() == 0
    batch = L.minibatch(spark.range(1000), *args, size=128)
    assert batch.count() == 128 and batch.distinct().count() == 128


def test_greedy_ties_take_the_lowest_action(spark):
    q = spark.createDataFrame([("a", 0, a, v) for a, v in [(3, 1.0), (1, 1.0), (2, 0.5)]], "product_id string, state int, action int, q double")
    assert L.greedy_actions(q, ["product_id"]).first()["action"] == 1
    assert one(spark, L.greedy_of_array(F.array(F.lit(0.0), F.lit(2.0), F.lit(2.0)))) == 1


def test_prior_leaves_the_product_out(spark):
    q = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 3.0), ("c", 0, 0, 5.0), ("c", 1, 0, 7.0)], "product_id string, state int, action int, q double")
    out = {(r["product_id"], r["state"]): r["q"] for r in L.pooled_prior(q).collect()}
    assert out == {("a", 0): 4.0, ("b", 0): 3.0, ("c", 0): 2.0, ("a", 1): 7.0, ("b", 1): 7.0}


def test_adaptation_takes_any_number_of_episodes(spark):
    rows = [("a", 0, 0, float(e), 0, True, e) for e in range(40)]
    moves = spark.createDataFrame(rows, "product_id string, state int, action int, reward double, next_state int, done boolean, episode int")
    prior = spark.createDataFrame([("a", 0, 1, 9.0)], "product_id string, state int, action int, q double")
    got = {r["action"]: r["q"] for r in L.adapted_q(moves, prior, n_episodes=30).collect()}
    assert got == {0: sum(range(30)) / 30, 1: 9.0}


# --- limits -------------------------------------------------------------------------


def test_half_up_leaves_what_has_no_digits_left(spark):
    nan, inf = float("nan"), float("inf")
    assert [one(spark, half_up(F.lit(x), 6)) for x in (1e15, -1e300, inf, -inf)] == [1e15, -1e300, inf, -inf]
    assert math.isnan(one(spark, half_up(F.lit(nan), 6))) and one(spark, half_up(F.lit(None).cast("double"), 6)) is None
    assert one(spark, half_up(F.lit(1234567.1234565), 6)) == math.floor(1234567.1234565 * 1e6 + 0.5) / 1e6


def test_hash_reaches_millions_of_positions(spark):
    drawn = spark.range(400_000).select(F.pmod(mixed_hash(F.lit(0), F.col("id"), F.lit(1), 3), F.lit(3_000_000)).alias("at"))
    low, high, different = drawn.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()
    # 400,000 draws of 3,000,000 hit 3e6 * (1 - exp(-0.1333)) places, about 374,500.
    assert low < 100 and high > 2_999_900 and 373_000 < different < 376_000
    whole = spark.range(300_000).select(mixed_hash(F.col("id"), F.lit(7), F.lit(1)).alias("h"))
    assert whole.agg(F.count_distinct("h"), F.min("h") >= 0, F.max("h") < F.lit(HASH_RANGE)).first() == (300_000, True, True)


def test_hash_takes_any_id(spark):
    ids = [123456789012345678, -(2**63), 2**63 - 1]
    drawn = [one(spark, mixed_hash(F.lit(i), F.lit(2**40), F.lit(-5))) for i in ids]
    assert len(set(drawn)) == 3 and all(0 <= x < HASH_RANGE for x in drawn)
    assert 0 <= one(spark, mixed_unit(F.lit(ids[0]), F.lit(0), F.lit(0))) < 1


def test_minibatch_is_no_prefix(spark):
    rows = spark.range(200_000).select(F.col("id").alias("p"), F.lit(0).alias("e"), F.lit(0).alias("s"))
    drawn = sorted(r["p"] for r in L.minibatch(rows, F.col("p"), F.col("e"), F.col("s"), 128, seed=1).collect())
    assert len(set(drawn)) == 128 and 80_000 < sum(drawn) / 128 < 120_000


@pytest.mark.parametrize(
    "text, want",
    {
        "12/1/2010 8:26": "2010-12-01 08:26:00",
        "12/1/10 8:26": "2010-12-01 08:26:00",
        "01-12-2010 08:26": "2010-01-12 08:26:00",
        "1 Dec 2010": "2010-12-01 00:00:00",
        "20101201": "2010-12-01 00:00:00",
        "2010-12-01T08:26:00": "2010-12-01 08:26:00",
        " 2010-12-01 ": "2010-12-01 00:00:00",
        "12:30": None,
        "13/45/2010": None,
        "5d": None,
        "": None,
    }.items(),
)
def test_spellings_of_times(spark, text, want):
    got = one(spark, clean.parse_time(F.lit(text), T.StringType()))
    assert (None if got is None else str(got)) == want


def test_numbers_have_no_letters_behind_them(spark):
    frame = spark.createDataFrame([(x, "1") for x in ("5", " 5.5 ", "1e3", "5d", "5f", "0x1", "", "-3", "NaN")], "Quantity string, Price string")
    got = [r["Quantity"] for r in clean.coerce_numbers(frame).collect()]
    assert got[:8] == [5.0, 5.5, 1000.0, None, None, None, None, -3.0] and math.isnan(got[8])


def test_rejected_rows_per_rule(spark):
    rows = [("C1", "a", "1", "1", "2010-12-01"), ("1", "a", "x", "1", "2010-12-01"), ("1", "a", "-1", "1", "2010-12-01"),
            ("1", None, "1", "1", "2010-12-01"), ("1", "a", "1", "1", "12:30"), ("1", "a", "1", "1", "2010-12-01"), (None, "a", "1", "NaN", "2010-12-01")]
    frame = spark.createDataFrame(rows, "Invoice string, StockCode string, Quantity string, Price string, InvoiceDate string")
    got = clean.rejected_rows(frame).first().asDict()
    assert got == {"cancelled": 1, "no_number": 1, "not_positive": 2, "no_code": 1, "no_time": 1, "kept": 1}
    assert clean.clean_rows(frame).count() == got["kept"]
