"""Registered queries: catalogue, joins, calendar and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import mixed_unit, product_number
from ..operators import calendar as K
from ..operators import catalogue as C
from ..operators import demand, policies
from ..operators.positions import with_position
from ..params import EpisodeParams
from ..session import fresh_path, write_once
from ..sources import dataset
from ..sources import driver_tables as D
from . import base as B
from . import cleaning  # noqa: F401  its table expressions are named below
from .registry import cte, query
from .sql import TWO_PI, code_order, level_price, mixed_hash, rnd, unit

HELD_OUT = "9"


@query(
    "F9",
    f"""SELECT product_id AS id, name, category, base_price, price_min, price_max, elasticity, base_demand,
        product_id = '{HELD_OUT}' AS is_held_out FROM described""",
)
def catalogue_listing(spark, sf_dir):
    return C.catalogue_listing(B.catalogue(spark, sf_dir), HELD_OUT)


@query("F10", f"SELECT * FROM described WHERE product_id = '{HELD_OUT}'")
def product_by_id(spark, sf_dir):
    return C.find_product(B.catalogue(spark, sf_dir), int(HELD_OUT))


@query(
    "F11",
    f"""SELECT product_id, name, position, CASE WHEN position <= 9 THEN 'train' ELSE 'held_out' END AS role
        FROM (SELECT *, row_number() OVER (ORDER BY {code_order('product_id')}) AS position FROM described)
        WHERE position <= 10""",
)
def train_and_held_out_products(spark, sf_dir):
    return C.split_catalogue(B.catalogue(spark, sf_dir), 9).select("product_id", "name", "position", "role")


SERIES_VALUES = f"{rnd('price')} AS price, {rnd('demand')} AS demand, {rnd('revenue', 4)} AS revenue, {rnd('seasonal')} AS seasonal"


@query(
    "F12",
    f"""SELECT strftime(date, '%Y-%m-%d') AS date, {SERIES_VALUES} FROM series
        WHERE product_id = '{HELD_OUT}' QUALIFY row_number() OVER (ORDER BY date) <= 365""",
)
def series_extract(spark, sf_dir):
    return B.rounded(C.series_extract(B.series(spark, sf_dir), HELD_OUT), revenue=4)


@query(
    "T2",
    f"SELECT product_id, date, day_of_week, day_of_year, {SERIES_VALUES} FROM series "
    "QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date) <= 365",
)
def first_year_of_each_series(spark, sf_dir):
    return B.rounded(C.first_days(B.series(spark, sf_dir), 365), revenue=4)


@query(
    "J2",
    f"""SELECT t.position, coalesce(f.product_id, t.product_id) AS product_id, t.name, t.category,
        coalesce(f.base_price, t.base_price) AS base_price, {rnd('coalesce(f.elasticity, t.elasticity)')} AS elasticity,
        coalesce(f.base_demand, t.base_demand) AS base_demand, coalesce(f.price_min, t.price_min) AS price_min,
        coalesce(f.price_max, t.price_max) AS price_max, t.noise_std, t.template_no
        FROM (SELECT *, row_number() OVER (ORDER BY template_no) AS position FROM templates) t
        LEFT JOIN (SELECT *, row_number() OVER (ORDER BY {code_order('product_id')}) AS position FROM fitted_part) f
        ON t.position = f.position""",
)
def templates_with_fitted_values(spark, sf_dir):
    merged = C.overlay_fitted(
        D.templates(spark, sf_dir), B.fitted(spark, sf_dir, "part"), order=[F.col("template_no").asc()]
    )
    return B.rounded(merged, base_price=None, base_demand=None, price_min=None, price_max=None, noise_std=None)


@query(
    "J3",
    f"""SELECT s.product_id, date, {rnd('price')} AS price, {rnd('demand')} AS demand, name, category, base_price, elasticity
        FROM series s JOIN described d ON s.product_id = d.product_id""",
)
def catalogue_with_series(spark, sf_dir):
    joined = C.with_series(B.catalogue(spark, sf_dir), B.series(spark, sf_dir))
    wanted = ["product_id", "date", "price", "demand", "name", "category", "base_price", "elasticity"]
    return B.rounded(joined.select(*wanted), base_price=None, elasticity=None)


@query(
    "J4",
    f"""SELECT o.o_orderkey, i.product_id, i.row_index, i.date, {rnd('i.seasonal')} AS seasonal
        FROM (SELECT l_orderkey AS o_orderkey, CAST(min(l_suppkey) AS VARCHAR) AS product_id FROM lineitem GROUP BY l_orderkey) l
        JOIN (SELECT o_orderkey, o_custkey % 60 AS ofs FROM orders) o USING (o_orderkey)
        JOIN indexed i ON i.product_id = l.product_id
        AND i.row_index = least((o.o_orderkey * 31) % i.n_rows + o.ofs, i.n_rows - 1)""",
)
def steps_with_calendar_rows(spark, sf_dir):
    """A step per order: the first product it holds, a start anywhere in that calendar, and an offset that may lead beyond its end."""
    first = B.lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").cast("string").alias("product_id"))
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("offset"))
    steps = orders.join(first, "o_orderkey")
    found = K.attach_calendar(steps, B.series(spark, sf_dir), lambda n: F.col("o_orderkey") * 31 % n)
    return B.rounded(
        found.select("o_orderkey", "product_id", F.col("row_index").cast("bigint").alias("row_index"), "date", "seasonal")
    )


@query(
    "J4",
    f"""SELECT l.l_orderkey, l.l_linenumber, i.product_id, i.row_index, i.date, {rnd('i.seasonal')} AS seasonal
        FROM lineitem l
        JOIN indexed i ON i.product_id = CAST(l.l_suppkey AS VARCHAR)
        AND i.row_index = least((l.l_orderkey * 31) % i.n_rows + l.l_linenumber * 9, i.n_rows - 1)""",
)
def line_steps_with_calendar_rows(spark, sf_dir):
    """A step per line: its supplier's calendar from a start anywhere in it, and an offset that may lead beyond its end."""
    steps = B.lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("product_id"), (F.col("l_linenumber") * 9).alias("offset")
    )
    found = K.attach_calendar(steps, B.series(spark, sf_dir), lambda n: F.col("l_orderkey") * 31 % n)
    return B.rounded(
        found.select(
            "l_orderkey", "l_linenumber", "product_id", F.col("row_index").cast("bigint").alias("row_index"), "date", "seasonal"
        )
    )


@query(
    "J5",
    """SELECT product_id, base_price, policy FROM described,
       (VALUES ('fixed'), ('random'), ('rule_based'), ('optimal')) p(policy)""",
)
def products_under_all_policies(spark, sf_dir):
    names = ["fixed", "random", "rule_based", "optimal"]
    return policies.with_policies(B.catalogue(spark, sf_dir), names).select("product_id", "base_price", "policy")


@query(
    "J6, X13",
    f"""SELECT product_id, CAST(level AS INTEGER) AS level, {rnd(level_price('level'))} AS price
        FROM described, range(11) r(level)""",
)
def products_at_all_price_levels(spark, sf_dir):
    return B.rounded(policies.with_price_levels(B.catalogue(spark, sf_dir)).select("product_id", "level", "price"))


@query(
    "U1",
    """SELECT product_id, name, category, base_price, elasticity, base_demand, price_min, price_max, noise_std,
              CAST(NULL AS BOOLEAN) AS is_custom FROM described
       UNION ALL
       SELECT CAST(99000 + (SELECT count(*) FROM described WHERE TRY_CAST(product_id AS BIGINT) >= 99000)
                   + s_suppkey AS VARCHAR), s_name, 'service', 10e0 + s_suppkey % 7, -0.5e0, 50e0,
              (10e0 + s_suppkey % 7) * 0.5e0, (10e0 + s_suppkey % 7) * 2e0, 0.1e0, true FROM supplier""",
)
def catalogue_with_custom_products(spark, sf_dir):
    custom = D.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.lit("service").alias("category"),
        (F.lit(10.0) + F.col("s_suppkey") % 7).alias("base_price"),
        F.lit(-0.5).alias("elasticity"),
        F.lit(50.0).alias("base_demand"),
        F.col("s_suppkey").alias("request_no"),
    )
    return C.add_custom_products(B.catalogue(spark, sf_dir), custom)


cte(
    "first_days",
    """SELECT product_id, min(date) AS start_date FROM series GROUP BY product_id""",
)


@query(
    "R1",
    """SELECT product_id, CAST(t AS INTEGER) AS t, CAST(start_date + CAST(t AS INTEGER) AS DATE) AS date
       FROM first_days, range(1095) r(t)""",
)
def product_date_spine(spark, sf_dir):
    starts = B.series(spark, sf_dir).groupBy("product_id").agg(F.min("date").alias("start_date"))
    return K.date_spine(starts, "start_date", 1095).select("product_id", "t", "date")


cte(
    "seasoned",
    """
    SELECT d.*, f.start_date, 0.05e0 + (k % 16) / 100e0 AS weekly_amp, 0.1e0 + (k % 31) / 100e0 AS annual_amp,
           300e0 + k % 61 AS annual_peak, ((k % 6) - 2) / 10000e0 AS trend_rate
    FROM (SELECT *, CAST(product_id AS BIGINT) AS k FROM described) d JOIN first_days f USING (product_id)""",
)
SEASONAL = (
    f"(1e0 + weekly_amp * sin({TWO_PI} * t / 7) + annual_amp * sin({TWO_PI} * (t - annual_peak) / 365) + trend_rate * t)"
)


@query(
    "R2, X5",
    f"""SELECT product_id, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
        CAST(dayofyear(date) AS INTEGER) AS day_of_year, {rnd('price')} AS price, {rnd('demand')} AS demand,
        {rnd('price * demand', 4)} AS revenue, {rnd('seasonal')} AS seasonal
        FROM (SELECT *, base_demand * seasonal * pow(price / base_price, elasticity) AS demand
              FROM (SELECT x.*, {SEASONAL} AS seasonal, coalesce(s.price, x.base_price) AS price
                    FROM (SELECT *, CAST(start_date + CAST(t AS INTEGER) AS DATE) AS date
                          FROM seasoned, range(1095) r(t)) x
                    LEFT JOIN series s ON s.product_id = x.product_id AND s.date = x.date))""",
)
def expected_series(spark, sf_dir):
    days = write_once(demand.priced_series(B.daily(spark, sf_dir)), "priced-days")
    figures = ["product_id", "base_price", "base_demand", "elasticity"]
    starts = days.groupBy(*figures).agg(F.min("date").alias("start_date"))
    products = D.season_parameters(D.described_catalogue(starts, spark, sf_dir))
    rows = K.expected_series(products, "start_date", 1095, prices=days)
    return B.rounded(rows, revenue=4)


@query(
    "R3, X6",
    f"""SELECT product_id, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(t + 1 AS INTEGER) AS day_of_year,
        base_price AS price, {rnd('demand')} AS demand, {rnd('demand * base_price', 4)} AS revenue, {rnd('seasonal')} AS seasonal
        FROM (SELECT *, greatest(0e0, base_demand * seasonal * (1e0 + 0.05e0 * z)) AS demand
              FROM (SELECT *, CAST(DATE '2023-01-01' + CAST(t AS INTEGER) AS DATE) AS date,
                           1e0 + 0.15e0 * sin({TWO_PI} * (t + 1) / 365) AS seasonal,
                           ({unit('product_id', '0', 't', 7)} - 0.5e0) * 2e0 AS z
                    FROM described, range(365) r(t)))""",
)
def custom_product_series(spark, sf_dir):
    def noise(product_id, day):
        return (mixed_unit(product_number(product_id), F.lit(0), day, 7) - F.lit(0.5)) * F.lit(2.0)

    return B.rounded(K.custom_series(B.catalogue(spark, sf_dir), noise), price=None, revenue=4)


cte(
    "episodes",
    f"""
    SELECT product_id, n_rows, CAST(episode AS INTEGER) AS episode,
           CAST({mixed_hash('product_id', 'episode', '0', 42)} % greatest(1, n_rows - 31) AS INTEGER) AS start
    FROM (SELECT product_id, count(*) AS n_rows FROM series GROUP BY product_id), range({B.EPISODES}) e(episode)""",
)
cte(
    "episode_days",
    """
    SELECT e.product_id, e.episode, e.start, CAST(step AS INTEGER) AS step, i.date, i.seasonal, i.day_of_week, i.day_of_year
    FROM (SELECT * FROM episodes, range(31) s(step)) e
    JOIN indexed i ON i.product_id = e.product_id AND i.row_index = least(e.start + e.step, e.n_rows - 1)""",
)


@query(
    "R4",
    f"""SELECT product_id, episode, start, step, date, {rnd('seasonal')} AS seasonal, day_of_week, day_of_year
        FROM episode_days WHERE step < 30""",
)
def episode_calendar_slices(spark, sf_dir):
    return B.rounded(K.episode_days(B.series(spark, sf_dir), B.EPISODES, EpisodeParams()))


@query(
    "R14",
    f"""WITH merged AS (
          SELECT t.*, t.product_id AS own_id, f.product_id AS code, f.base_price AS f_price, f.elasticity AS f_elasticity,
                 f.base_demand AS f_demand
          FROM (SELECT *, row_number() OVER (ORDER BY template_no) AS position FROM templates) t
          LEFT JOIN (SELECT *, row_number() OVER (ORDER BY {code_order('product_id')}) AS position FROM fitted_raw) f
          ON t.position = f.position),
        logged AS (SELECT "StockCode" AS code, count(*) AS n_days, sum(total_qty) AS total_demand FROM dense_raw GROUP BY ALL),
        seasons AS (
          SELECT position, base_demand, 0.05e0 + (k % 16) / 100e0 AS weekly_amp, 0.1e0 + (k % 31) / 100e0 AS annual_amp,
                 300e0 + k % 61 AS annual_peak, ((k % 6) - 2) / 10000e0 AS trend_rate
          FROM (SELECT *, template_no AS k FROM merged WHERE code IS NULL)),
        expected AS (SELECT position, count(*) AS n_days, sum(base_demand * {SEASONAL}) AS total_demand
                     FROM seasons, range(1095) r(t) GROUP BY position)
        SELECT m.position, coalesce(m.code, own_id) AS product_id, name, coalesce(f_price, base_price) AS base_price,
               {rnd('coalesce(f_elasticity, elasticity)')} AS elasticity, coalesce(f_demand, base_demand) AS base_demand,
               coalesce(l.n_days, e.n_days) AS n_days, {rnd('coalesce(l.total_demand, e.total_demand)', 4)} AS total_demand
        FROM merged m LEFT JOIN logged l ON l.code = m.code LEFT JOIN expected e ON e.position = m.position""",
)
def dataset_build(spark, sf_dir):
    """From text files to the dataset that is read back: every product has its series."""
    path = fresh_path(spark, "dataset-build")
    D.raw_transactions(spark, sf_dir).write.option("header", True).option("compression", "gzip").csv(f"{path}/lines")
    templates = D.season_parameters(D.templates(spark, sf_dir), "template_no")
    products, series = dataset.dataset_from_csv(spark, f"{path}/lines", templates, [F.col("template_no").asc()], f"{path}/dataset")
    totals = series.groupBy("product_id").agg(F.count("*").alias("n_days"), F.sum("demand").alias("total_demand"))
    out = products.join(totals, "product_id")
    figures = ["position", "product_id", "name", "base_price", "elasticity", "base_demand", "n_days", "total_demand"]
    return B.rounded(out.select(figures), base_price=None, base_demand=None, total_demand=4)


@query(
    "T5",
    f"""SELECT product_id, row_number() OVER (ORDER BY {code_order('product_id')}) AS position FROM described""",
)
def catalogue_positions(spark, sf_dir):
    return with_position(B.catalogue(spark, sf_dir).select("product_id"), C.code_order("product_id"))
