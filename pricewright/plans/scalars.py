"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions.numbers import half_up, mixed_unit
from ..operators.features import calendar_features
from ..sources import driver_tables as D
from . import base as B
from .registry import cte, query
from .sql import TWO_PI, clip, grid, level_price, nearest, optimal_price, rnd, unit, whole

KEY = "l_orderkey, l_linenumber"


def _key_cols():
    return ["l_orderkey", "l_linenumber"]


@query("X1", f"SELECT {KEY}, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week FROM lineitem")
def day_of_week(spark, sf_dir):
    return B.lines(spark, sf_dir).select(*_key_cols(), P.day_of_week(F.col("l_shipdate")).alias("day_of_week"))


@query("X2", f"SELECT {KEY}, CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year FROM lineitem")
def day_of_year(spark, sf_dir):
    return B.lines(spark, sf_dir).select(*_key_cols(), P.day_of_year(F.col("l_shipdate")).alias("day_of_year"))


@query("X3", f"SELECT {KEY}, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def iso_dates(spark, sf_dir):
    return B.lines(spark, sf_dir).select(*_key_cols(), P.iso_date(F.col("l_shipdate")).alias("day"))


@query(
    "X4",
    f"""SELECT {KEY}, {rnd(f'sin({TWO_PI} * (isodow(l_shipdate) - 1) / 7)')} AS dow_sin,
        {rnd(f'cos({TWO_PI} * (isodow(l_shipdate) - 1) / 7)')} AS dow_cos,
        {rnd(f'sin({TWO_PI} * dayofyear(l_shipdate) / 365)')} AS season_signal FROM lineitem""",
)
def cyclic_calendar_features(spark, sf_dir):
    rows = B.lines(spark, sf_dir).select(
        *_key_cols(),
        P.day_of_week(F.col("l_shipdate")).alias("day_of_week"),
        P.day_of_year(F.col("l_shipdate")).alias("day_of_year"),
    )
    return B.rounded(calendar_features(rows).drop("day_of_week", "day_of_year"))


@query(
    "X5",
    f"""SELECT {KEY}, {rnd(f'''1e0 + 0.1e0 * sin({TWO_PI} * t / 7) + 0.25e0 * sin({TWO_PI} * (t - 330e0) / 365) + 0.0001e0 * t''')} AS seasonal
        FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t FROM lineitem)""",
)
def seasonal_factor(spark, sf_dir):
    t = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    factor = P.seasonal_factor(t, F.lit(0.1), F.lit(0.25), F.lit(330.0), F.lit(0.0001))
    return B.rounded(B.lines(spark, sf_dir).select(*_key_cols(), factor.alias("seasonal")))


@query(
    "X6",
    f"""SELECT {KEY}, {rnd(f'1e0 + 0.15e0 * sin({TWO_PI} * dayofyear(l_shipdate) / 365)')} AS seasonal FROM lineitem""",
)
def simple_seasonal_factor(spark, sf_dir):
    return B.rounded(
        B.lines(spark, sf_dir).select(
            *_key_cols(), P.simple_seasonal(P.day_of_year(F.col("l_shipdate"))).alias("seasonal")
        )
    )


# Lines beside the fitted figures of their supplier: the input of the demand formulas.
cte(
    "line_demand",
    f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, d.*,
           1e0 + 0.15e0 * sin({TWO_PI} * dayofyear(l_shipdate) / 365) AS seasonal,
           CAST(l_quantity AS INTEGER) AS inventory,
           ({unit('l_orderkey', 'l_linenumber', '0')} - 0.5e0) * 2e0 AS z
    FROM lineitem JOIN described d ON d.product_id = CAST(l_suppkey AS VARCHAR)""",
)
RAW = "greatest(0e0, base_demand * seasonal * pow(price / base_price, elasticity))"
NOISY = f"greatest(0e0, {RAW} + z * noise_std * {RAW})"
SOLD = f"least({whole(NOISY)}, inventory)"
LOST = f"greatest(0, {whole(NOISY)} - inventory)"
REWARD = f"({SOLD} * price - 2e0 * {LOST} - 0.001e0 * inventory)"


def _line_demand(spark, sf_dir):
    lines = B.lines(spark, sf_dir).select(
        *_key_cols(),
        F.col("l_suppkey").cast("string").alias("product_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        P.simple_seasonal(P.day_of_year(F.col("l_shipdate"))).alias("seasonal"),
        F.col("l_quantity").cast("int").alias("inventory"),
        ((mixed_unit(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(0)) - F.lit(0.5)) * F.lit(2.0)).alias("z"),
    )
    rows = lines.join(B.catalogue(spark, sf_dir), "product_id")
    raw = P.demand_curve(
        F.col("base_demand"), F.col("seasonal"), F.col("price"), F.col("base_price"), F.col("elasticity")
    )
    return rows.withColumn("raw", raw).withColumn("demand", P.noisy_demand(F.col("raw"), F.col("z"), F.col("noise_std")))


@query("X7", f"SELECT {KEY}, {rnd(RAW)} AS raw_demand FROM line_demand")
def demand_curve(spark, sf_dir):
    return B.rounded(_line_demand(spark, sf_dir).select(*_key_cols(), F.col("raw").alias("raw_demand")))


@query("X8", f"SELECT {KEY}, {rnd(NOISY)} AS demand FROM line_demand")
def noisy_demand(spark, sf_dir):
    return B.rounded(_line_demand(spark, sf_dir).select(*_key_cols(), "demand"))


@query("X9", f"SELECT {KEY}, {SOLD} AS units_sold, {LOST} AS lost_units FROM line_demand")
def units_sold(spark, sf_dir):
    demand, stock = F.col("demand"), F.col("inventory")
    return _line_demand(spark, sf_dir).select(
        *_key_cols(), P.units_sold(demand, stock).alias("units_sold"), P.lost_units(demand, stock).alias("lost_units")
    )


@query(
    "X10",
    f"""SELECT {KEY}, {rnd(REWARD)} AS raw_reward, {rnd(f'{REWARD} / greatest(1e0, base_demand * base_price)')} AS reward
        FROM line_demand""",
)
def step_reward(spark, sf_dir):
    demand, stock = F.col("demand"), F.col("inventory")
    raw = P.step_reward(P.units_sold(demand, stock), F.col("price"), P.lost_units(demand, stock), stock)
    scale = P.reward_scale(F.col("base_demand"), F.col("base_price"))
    return B.rounded(
        _line_demand(spark, sf_dir).select(*_key_cols(), raw.alias("raw_reward"), (raw / scale).alias("reward"))
    )


@query("X11", f"SELECT product_id, {rnd('greatest(1e0, base_demand * base_price)')} AS scale FROM described")
def reward_scale(spark, sf_dir):
    scale = P.reward_scale(F.col("base_demand"), F.col("base_price"))
    return B.rounded(B.catalogue(spark, sf_dir).select("product_id", scale.alias("scale")))


@query(
    "X12",
    f"""SELECT {KEY}, {rnd('price * 0.5e0', 2)} AS price_min, {rnd('price * 2e0', 2)} AS price_max,
        {rnd('price * 0.5e0')} AS custom_min, {rnd('price * 2e0')} AS custom_max
        FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem)""",
)
def price_bounds(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    low, high = P.price_bounds(price)
    free_low, free_high = P.price_bounds(price, digits=None)
    return B.rounded(
        B.lines(spark, sf_dir).select(
            *_key_cols(),
            low.alias("price_min"),
            high.alias("price_max"),
            free_low.alias("custom_min"),
            free_high.alias("custom_max"),
        ),
        price_min=None,
        price_max=None,
    )


@query("X14", f"SELECT {KEY}, {nearest('price')} AS level FROM line_demand")
def nearest_price_level(spark, sf_dir):
    levels = P.price_grid(F.col("price_min"), F.col("price_max"))
    rows = _line_demand(spark, sf_dir)
    return rows.select(*_key_cols(), P.nearest_level(levels, F.col("price")).alias("level"))


@query(
    "X15",
    f"""SELECT product_id, {rnd(optimal_price())} AS best_price,
        {rnd(clip(optimal_price(), 'price_min', 'price_max'))} AS grid_price,
        {nearest(clip(optimal_price(), 'price_min', 'price_max'))} AS level FROM templates""",
)
def revenue_maximising_price(spark, sf_dir):
    best = P.revenue_maximising_price(F.col("base_price"), F.col("elasticity"))
    kept = F.greatest(F.col("price_min"), F.least(F.col("price_max"), best))
    levels = P.price_grid(F.col("price_min"), F.col("price_max"))
    return B.rounded(
        D.templates(spark, sf_dir).select(
            "product_id", best.alias("best_price"), kept.alias("grid_price"), P.nearest_level(levels, kept).alias("level")
        )
    )


TEXT = "replace(replace(lower(category), ' & ', '_'), ' ', '_')"
CATEGORY = f"""CASE WHEN contains({TEXT}, 'physical_good') THEN 0 WHEN contains({TEXT}, 'subscription') THEN 1
    WHEN contains({TEXT}, 'service') THEN 2 WHEN contains({TEXT}, 'digital') THEN 3
    WHEN contains({TEXT}, 'perishable') THEN 4 ELSE 0 END"""


@query(
    "X16",
    f"""SELECT product_id, {CATEGORY} AS category_index, {rnd(f'({CATEGORY}) / 4e0 * 2e0 - 1e0')} AS category_signal
        FROM templates""",
)
def category_signal(spark, sf_dir):
    category = F.col("category")
    return B.rounded(
        D.templates(spark, sf_dir).select(
            "product_id",
            P.category_index(category).alias("category_index"),
            P.category_signal(category).alias("category_signal"),
        )
    )


@query(
    "X17",
    f"SELECT {KEY}, {rnd(clip('(price / base_price - 1e0) / 0.5e0', '-2e0', '2e0'))} AS price_ratio FROM line_demand",
)
def price_ratio(spark, sf_dir):
    return B.rounded(
        _line_demand(spark, sf_dir).select(
            *_key_cols(), P.price_ratio(F.col("price"), F.col("base_price")).alias("price_ratio")
        )
    )


@query(
    "X18",
    f"""SELECT {KEY}, {rnd('CAST(l_quantity AS INTEGER) / 50e0 * 2e0 - 1e0')} AS inventory_ratio,
        {rnd('1e0 - CAST(l_quantity AS INTEGER) / 50e0')} AS stockout_risk FROM lineitem""",
)
def inventory_signals(spark, sf_dir):
    stock = F.col("l_quantity").cast("int")
    return B.rounded(
        B.lines(spark, sf_dir).select(
            *_key_cols(),
            P.inventory_ratio(stock, 50).alias("inventory_ratio"),
            P.stockout_risk(stock, 50).alias("stockout_risk"),
        )
    )


@query("X19", f"SELECT product_id, {rnd(clip('elasticity / 3e0', '-2e0', '2e0'))} AS elasticity_signal FROM templates")
def elasticity_signal(spark, sf_dir):
    return B.rounded(
        D.templates(spark, sf_dir).select(
            "product_id", P.elasticity_signal(F.col("elasticity")).alias("elasticity_signal")
        )
    )


@query(
    "X20",
    f"""SELECT o_orderkey, {rnd('greatest(0.05e0, 1e0 * pow(0.995e0, o_orderkey))')} AS geometric,
        {rnd('greatest(0.05e0, 0.3e0 - 0.05e0 * (o_orderkey % 10))')} AS inner_linear,
        {rnd('greatest(0.05e0, 0.3e0 - 0.025e0 * (o_orderkey % 20))')} AS adapt_linear FROM orders""",
)
def exploration_schedules(spark, sf_dir):
    n = F.col("o_orderkey")
    return B.rounded(
        D.table(spark, sf_dir, "orders").select(
            "o_orderkey",
            P.geometric_epsilon(n).alias("geometric"),
            P.linear_epsilon(n % 10, 0.05).alias("inner_linear"),
            P.linear_epsilon(n % 20, 0.025).alias("adapt_linear"),
        )
    )


GAP = "(l_quantity - 25e0) / 20e0"


@query(
    "X21",
    f"""SELECT l_suppkey, {rnd(f'avg(CASE WHEN abs({GAP}) < 1 THEN 0.5e0 * {GAP} * {GAP} ELSE abs({GAP}) - 0.5e0 END)')} AS mean_loss
        FROM lineitem GROUP BY l_suppkey""",
)
def huber_loss(spark, sf_dir):
    gap = (F.col("l_quantity") - F.lit(25.0)) / F.lit(20.0)
    return B.rounded(B.lines(spark, sf_dir).groupBy("l_suppkey").agg(F.avg(P.huber(gap)).alias("mean_loss")))


@query(
    "X22",
    f"""SELECT {KEY}, {rnd('price', 4)} AS price, {rnd(NOISY, 2)} AS demand, {rnd(f'{SOLD} * price', 2)} AS revenue,
        {rnd(f'{REWARD} / greatest(1e0, base_demand * base_price)', 4)} AS reward FROM line_demand""",
)
def step_log_rounding(spark, sf_dir):
    demand, stock, price = F.col("demand"), F.col("inventory"), F.col("price")
    sold = P.units_sold(demand, stock)
    reward = P.step_reward(sold, price, P.lost_units(demand, stock), stock) / P.reward_scale(
        F.col("base_demand"), F.col("base_price")
    )
    return _line_demand(spark, sf_dir).select(
        *_key_cols(),
        half_up(price, 4).alias("price"),
        half_up(demand, 2).alias("demand"),
        half_up(sold * price, 2).alias("revenue"),
        half_up(reward, 4).alias("reward"),
    )


@query("X23", "SELECT p_partkey, printf('P%03d', p_partkey) AS product_id FROM part")
def product_codes(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", P.product_code(F.col("p_partkey")).alias("product_id"))


@query(
    "X13",
    f"""SELECT product_id, CAST(i AS INTEGER) AS level, {rnd('g[CAST(i + 1 AS INTEGER)]')} AS price,
        {rnd(level_price('i'))} AS direct FROM (SELECT *, {grid()} AS g FROM templates), range(11) r(i)""",
)
def price_grid(spark, sf_dir):
    rows = D.templates(spark, sf_dir).withColumn("g", P.price_grid(F.col("price_min"), F.col("price_max")))
    out = rows.select("product_id", "price_min", "price_max", F.posexplode("g").alias("level", "price"))
    direct = P.level_price(F.col("level"), F.col("price_min"), F.col("price_max"), 11)
    return B.rounded(out.select("product_id", "level", "price", direct.alias("direct")))
