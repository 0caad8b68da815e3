"""Episodes of logged days: what really was charged and sold, cut into consecutive episodes of equal length.

Nothing is generated here.  Price and demand are those of the daily series, stock comes from
the ledger over the whole series, and the action is the price level nearest to the day's price.
Only histories start anew with each episode, full of the product's base figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pricing as P
from ..functions.numbers import half_up
from ..params import EpisodeParams
from .ledger import stock_ledger
from .windows import demand_trend

EPISODE_KEYS = ["product_id", "policy", "episode"]
FIGURES = ("base_price", "base_demand", "elasticity")
BOUNDS = ("price_min", "price_max")
BOOKED = ("price", "demand", "units_sold", "lost_units", "revenue", "raw_reward", "inventory_before", "inventory")


def logged_steps(catalogue: DataFrame, series: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """``steps_of_days`` for a catalogue and a series that come as two tables."""
    extra = [c for c in ("category",) if c in catalogue.columns]
    products = catalogue.select("product_id", *FIGURES, *BOUNDS, *extra)
    return steps_of_days(series.select("product_id", "date", "demand", "price").join(products, "product_id"), params)


def steps_of_days(days: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """One row per product and day, with the product's figures, numbered by episode and step.

    The whole calendar of a product is cut into consecutive episodes; the last one may be shorter.  ``days`` has
    the figures of the product beside each day.  ``policy`` tells how the episode was priced on its first day:
    ``below_list``, ``at_list`` or ``above_list``, by the price level against that of the base price.
    ``next_day_of_week`` and ``next_day_of_year`` are those of the next logged day, and of the last day itself at the end;
    ``oldest_price`` is the start of the price history after the step.  All steps share the exchange of the
    ledger on the product; a product has a row per calendar day at most.
    """
    p = params
    extra = [c for c in ("category",) if c in days.columns]
    figures = ["product_id", *FIGURES, *BOUNDS, *extra]
    booked = stock_ledger(days.select(*figures, "date", "demand", "price"), figures, "date", p)
    product = Window.partitionBy("product_id")
    row, length = F.col("_row"), F.lit(p.episode_len)
    grid = P.price_grid(F.col("price_min"), F.col("price_max"), p.price_levels)
    rows = (
        booked.withColumnRenamed("step", "_row")
        .withColumn("n_rows", F.count("*").over(product).cast("int"))
        .withColumn("_next", F.coalesce(F.lead("date").over(product.orderBy("_row")), F.col("date")))
        .withColumn("episode", F.floor(row / length).cast("int"))
        .withColumn("start", F.col("episode") * length)
        .withColumn("step", (row - F.col("start")).cast("int"))
        .withColumn("action", P.nearest_level(grid, F.col("price")))
    )
    begun = F.first("action").over(Window.partitionBy("product_id", "episode").orderBy("step"))
    listed = P.nearest_level(grid, F.col("base_price"))
    policy = F.when(begun < listed, "below_list").when(begun > listed, "above_list").otherwise("at_list")
    rows = rows.withColumn("policy", policy)
    rows = demand_trend(rows, EPISODE_KEYS, "step", "units_sold", p.demand_history).withColumnRenamed("demand_trend", "trend")
    ordered = Window.partitionBy(*EPISODE_KEYS).orderBy("step")
    unmoved = P.demand_trend(F.col("base_demand"), F.col("base_demand"))
    scale = P.reward_scale(F.col("base_demand"), F.col("base_price")) if p.normalize_reward else F.lit(1.0)
    rows = (
        rows.withColumn("reward", F.col("raw_reward") / scale)
        .withColumn("trend_before", F.coalesce(F.lag("trend").over(ordered), unmoved))
        .withColumn("oldest_price", F.coalesce(F.lag("price", p.price_history - 1).over(ordered), F.col("base_price")))
        .withColumn("next_day_of_week", P.day_of_week(F.col("_next")))
        .withColumn("next_day_of_year", P.day_of_year(F.col("_next")))
    )
    return rows.select(
        *EPISODE_KEYS, "start", "n_rows", "step", *FIGURES, *extra, *BOOKED, "trend", "action", "reward",
        "trend_before", "oldest_price", "next_day_of_week", "next_day_of_year",
    )


def _in_first_half():
    return 2 * (F.col("start") + F.col("step") + 1) <= F.col("n_rows")


def earlier(steps: DataFrame) -> DataFrame:
    """The first half of each product's days: to learn from."""
    return steps.filter(_in_first_half())


def later(steps: DataFrame) -> DataFrame:
    """The other days, one at least of every product: to evaluate on."""
    return steps.filter(~_in_first_half())


def rounded_step_log(steps: DataFrame) -> DataFrame:
    """Step log as it is shown to users: days from 1, rounded figures."""
    return steps.select(
        *EPISODE_KEYS,
        (F.col("step") + 1).alias("day"),
        half_up(F.col("price"), 4).alias("price"),
        half_up(F.col("demand"), 2).alias("demand"),
        "units_sold",
        half_up(F.col("revenue"), 2).alias("revenue"),
        "inventory",
        half_up(F.col("reward"), 4).alias("reward"),
    )


def price_traces(steps: DataFrame) -> DataFrame:
    return steps.select(*EPISODE_KEYS, (F.col("step") + 1).alias("day"), "price", "revenue")
