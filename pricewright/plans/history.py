"""Registered queries: histories, moving averages and other windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.calendar import with_row_index
from ..operators.demand import product_series
from . import base as B
from .registry import cte, query
from .sql import clip, rnd

# Daily series beside the fitted figures of the product.
cte(
    "priced_days",
    """
    SELECT s.product_id, s.date, s.price, CAST(trunc(s.demand) AS BIGINT) AS units_sold, s.revenue,
           d.base_price, d.base_demand
    FROM series s JOIN described d ON s.product_id = d.product_id""",
)


def _priced_days(spark, sf_dir):
    return B.priced(spark, sf_dir).select(
        "product_id", "date", "price", F.col("demand").cast("bigint").alias("units_sold"), "revenue", "base_price", "base_demand"
    )


KEYS = ["product_id"]
TREND = clip("((total + (7 - seen) * base_demand) / 7e0) / (base_demand + 1e-8) - 1e0", "-2e0", "2e0")


@query(
    "W1",
    f"""SELECT product_id, date, units_sold, {rnd(TREND)} AS demand_trend
        FROM (SELECT *, count(*) OVER w AS seen, sum(units_sold) OVER w AS total FROM priced_days
              WINDOW w AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
)
def demand_trend(spark, sf_dir):
    rows = W.demand_trend(_priced_days(spark, sf_dir), KEYS, "date")
    return B.rounded(rows.select("product_id", "date", "units_sold", "demand_trend"))


MOMENTUM = clip("(price - coalesce(oldest, base_price)) / (base_price + 1e-8)", "-1e0", "1e0")


@query(
    "W2",
    f"""SELECT product_id, date, {rnd(MOMENTUM)} AS price_momentum
        FROM (SELECT *, lag(price, 2) OVER (PARTITION BY product_id ORDER BY date) AS oldest FROM priced_days)""",
)
def price_momentum(spark, sf_dir):
    rows = W.price_momentum(_priced_days(spark, sf_dir), KEYS, "date")
    return B.rounded(rows.select("product_id", "date", "price_momentum"))


@query(
    "W3",
    f"""SELECT product_id, date, {rnd('price')} AS price,
        {rnd('coalesce(lag(price) OVER (PARTITION BY product_id ORDER BY date), base_price)')} AS prev_price
        FROM priced_days""",
)
def previous_price(spark, sf_dir):
    rows = W.previous_price(_priced_days(spark, sf_dir), KEYS, "date")
    return B.rounded(rows.select("product_id", "date", "price", "prev_price"))


# Curves: daily demand of a part or supplier by day number; many parts have fewer days than a window.
for _grain in ("part", "supplier"):
    cte(
        f"curve_{_grain}",
        f"""
        SELECT "StockCode" AS product_id, row_number() OVER (PARTITION BY "StockCode" ORDER BY "Date") - 1 AS position,
               total_qty AS value, count(*) OVER (PARTITION BY "StockCode") AS n
        FROM daily_{_grain}""",
    )


def _curve(spark, sf_dir, grain):
    rows = with_row_index(product_series(B.daily(spark, sf_dir, grain)))
    return rows.select("product_id", F.col("row_index").cast("bigint").alias("position"), F.col("demand").alias("value"))


def _smooth_sql(grain: str, window: int) -> str:
    return f"""
    SELECT product_id, position, CASE WHEN n < {window} THEN value ELSE mean END AS smoothed,
           CASE WHEN n < {window} THEN position ELSE position - {window - 1} END + {window // 2} AS x
    FROM (SELECT *, avg(value) OVER (PARTITION BY product_id ORDER BY position
                                     ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS mean
          FROM curve_{grain})
    WHERE n < {window} OR position >= {window - 1}"""


@query("W4", f"SELECT product_id, position, {rnd('smoothed')} AS smoothed FROM ({_smooth_sql('part', 20)})")
def moving_average(spark, sf_dir):
    rows = W.moving_average(_curve(spark, sf_dir, "part"), KEYS, "position", "value", window=20)
    return B.rounded(rows.select("product_id", "position", "smoothed"))


@query(
    "W5",
    f"""SELECT product_id, x, {rnd('smoothed')} AS smoothed,
        {rnd('max(smoothed) OVER (PARTITION BY product_id)')} AS best_smoothed FROM ({_smooth_sql('supplier', 30)})""",
)
def smoothed_learning_curve(spark, sf_dir):
    rows = W.smoothed_curve(_curve(spark, sf_dir, "supplier"), KEYS, "position", "value", window=30)
    return B.rounded(rows.select("product_id", "x", "smoothed", "best_smoothed"))


@query(
    "W6",
    f"""SELECT product_id, position + 1 AS position, {rnd('mean')} AS trailing_mean
        FROM (SELECT *, avg(value) OVER (PARTITION BY product_id ORDER BY position
                                         ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean FROM curve_supplier)
        WHERE (position + 1) % 100 = 0""",
)
def trailing_averages(spark, sf_dir):
    rows = W.trailing_averages(_curve(spark, sf_dir, "supplier"), KEYS, "position", "value", every=100)
    return B.rounded(rows.select("product_id", "position", "trailing_mean"))


WALK = clip(
    "base_price + sum((price - base_price) * 0.02e0) OVER "
    "(PARTITION BY product_id ORDER BY date ROWS UNBOUNDED PRECEDING) * 0.1e0",
    "base_price * 0.5e0",
    "base_price * 2e0",
)


@query("W8", f"SELECT product_id, date, {rnd(WALK, 4)} AS price FROM priced_days")
def clipped_price_walk(spark, sf_dir):
    rows = _priced_days(spark, sf_dir).withColumn("noise", (F.col("price") - F.col("base_price")) * F.lit(0.02))
    return B.rounded(W.price_walk(rows, KEYS, "date").select("product_id", "date", "price"), 4)
