"""Daily demand per product and the elasticity fitted to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import clip, half_up
from ..functions.pricing import day_of_week, day_of_year, price_bounds, simple_seasonal
from ..params import FitParams


def daily_demand(transactions: DataFrame) -> DataFrame:
    """One row per product and day: unweighted mean line price, total quantity.

    Lines are combined before the shuffle, so a product with a third of all lines
    still sends at most one row per day and map task.
    """
    return transactions.groupBy("StockCode", "Date").agg(
        F.avg("Price").alias("avg_price"), F.sum("Quantity").alias("total_qty")
    )


def keep_dense_products(daily: DataFrame, min_days: int = 30) -> DataFrame:
    """Products with at least ``min_days`` days.  A window group is one calendar at most."""
    days = F.count("*").over(Window.partitionBy("StockCode"))
    return daily.withColumn("n_days", days).filter(F.col("n_days") >= min_days).drop("n_days")


def in_date_order(daily: DataFrame) -> DataFrame:
    """Presentation order; inside a plan nothing relies on it."""
    return daily.orderBy("Date", "StockCode")


def product_levels(daily: DataFrame) -> DataFrame:
    """Mean price and quantity over the days with a positive price and quantity."""
    usable = daily.filter((F.col("avg_price") > 0) & (F.col("total_qty") > 0))
    return usable.groupBy("StockCode").agg(
        F.avg("avg_price").alias("base_price"),
        F.avg("total_qty").alias("base_demand"),
        F.count("*").alias("n_days"),
    )


def log_points(daily: DataFrame, params: FitParams = FitParams()) -> DataFrame:
    """Log price and log quantity with a flag for points inside ``sigma`` on both."""
    group = Window.partitionBy("StockCode")
    points = daily.filter((F.col("avg_price") > 0) & (F.col("total_qty") > 0)).select(
        "StockCode", "Date", "avg_price", "total_qty", F.ln("avg_price").alias("lp"), F.ln("total_qty").alias("lq")
    )
    inside, varied = F.lit(True), F.lit(True)
    for name in ("lp", "lq"):
        spread = F.stddev_pop(name).over(group)
        inside = inside & (F.abs(F.col(name) - F.avg(name).over(group)) < F.lit(params.sigma) * spread)
        varied = varied & (F.min(name).over(group) < F.max(name).over(group))
    # A constant column has no spread, so no point is strictly inside it; the exact
    # test keeps rounding in the spread from letting some through.
    return points.withColumn("inside", inside & varied)


def without_outliers(daily: DataFrame, params: FitParams = FitParams()) -> DataFrame:
    return log_points(daily, params).filter("inside").select("StockCode", "Date", "avg_price", "total_qty")


def fit_elasticity(daily: DataFrame, params: FitParams = FitParams(), *extra: Column) -> DataFrame:
    """Log-log slope per product, clipped, with the product's mean price and demand.

    Masked points become nulls inside the aggregate, so a product whose points are
    all masked keeps its row.  The windows and the aggregate share one shuffle.
    ``extra`` aggregates over the usable days ride along in the same pass.
    """
    x, y = F.when(F.col("inside"), F.col("lp")), F.when(F.col("inside"), F.col("lq"))
    fitted = (
        log_points(daily, params)
        .groupBy("StockCode")
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.count("*").alias("n_points"),
            F.avg("avg_price").alias("base_price"),
            F.avg("total_qty").alias("base_demand"),
            *extra,
        )
    )
    carried = [c for c in fitted.columns if c not in ("StockCode", "slope", "n_points", "base_price", "base_demand")]
    # No variation left means a flat fit, which the upper bound turns into ``high``.
    flat = F.coalesce(F.col("slope"), F.lit(0.0))
    few = F.col("n_points") < params.min_points
    return fitted.select(
        "StockCode",
        F.when(few, F.lit(params.fallback)).otherwise(clip(flat, params.low, params.high)).alias("elasticity"),
        "base_demand",
        "base_price",
        "n_points",
        (~few & ((flat < params.low) | (flat > params.high))).alias("clipped"),
        *carried,
    )


def fitted_catalogue(fits: DataFrame, *keep: str) -> DataFrame:
    """Rounded catalogue row per fitted product, and the columns of ``fits`` to keep beside it."""
    low, high = price_bounds(F.col("base_price"))
    return fits.select(
        F.col("StockCode").alias("product_id"),
        half_up(F.col("base_price"), 2).alias("base_price"),
        half_up(F.col("elasticity"), 3).alias("elasticity"),
        half_up(F.col("base_demand"), 1).alias("base_demand"),
        low.alias("price_min"),
        high.alias("price_max"),
        *keep,
    )


def elasticity_catalogue(transactions: DataFrame, params: FitParams = FitParams()) -> DataFrame:
    """From cleaned transactions to the fitted catalogue."""
    daily = keep_dense_products(daily_demand(transactions), params.min_days)
    return fitted_catalogue(fit_elasticity(daily, params))


def priced_series(daily: DataFrame, params: FitParams = FitParams()) -> DataFrame:
    """The series of every fitted product with its catalogue figures on each day.

    Same figures as ``elasticity_catalogue``, taken by windows over the daily table, so series and fit share one
    exchange on the product, and the lines behind them are read once.
    """
    group = Window.partitionBy("StockCode")
    usable = (F.col("avg_price") > 0) & (F.col("total_qty") > 0)
    days = keep_dense_products(daily, params.min_days).withColumn("_usable", usable)
    masked = days
    for name, source in (("lp", "avg_price"), ("lq", "total_qty")):
        masked = masked.withColumn(name, F.when(F.col("_usable"), F.ln(source)))
    inside = F.lit(True)
    for name in ("lp", "lq"):
        spread = F.stddev_pop(name).over(group)
        inside = inside & (F.abs(F.col(name) - F.avg(name).over(group)) < F.lit(params.sigma) * spread)
        inside = inside & (F.min(name).over(group) < F.max(name).over(group))
    masked = masked.withColumn("_inside", inside)
    x, y = F.when(F.col("_inside"), F.col("lp")), F.when(F.col("_inside"), F.col("lq"))
    flat = F.coalesce(F.regr_slope(y, x).over(group), F.lit(0.0))
    n_points = F.count(F.when(F.col("_usable"), 1)).over(group)
    fitted = masked.select(
        "StockCode", "Date", "avg_price", "total_qty",
        n_points.alias("_points"),
        F.avg(F.when(F.col("_usable"), F.col("avg_price"))).over(group).alias("base_price"),
        F.avg(F.when(F.col("_usable"), F.col("total_qty"))).over(group).alias("base_demand"),
        F.when(n_points < params.min_points, F.lit(params.fallback)).otherwise(clip(flat, params.low, params.high)).alias("elasticity"),
    ).filter("_points > 0")
    figures = ("base_price", "elasticity", "base_demand", "price_min", "price_max")
    return product_series(fitted_catalogue(fitted, "StockCode", "Date", "avg_price", "total_qty"), *figures)


def product_series(daily: DataFrame, *keep: str) -> DataFrame:
    """The fixed columns of a series per product, from a daily table, and the columns to keep beside them."""
    dow, doy = day_of_week(F.col("Date")), day_of_year(F.col("Date"))
    return daily.select(
        F.col("StockCode").alias("product_id"),
        F.col("Date").alias("date"),
        dow.alias("day_of_week"),
        doy.alias("day_of_year"),
        F.col("avg_price").alias("price"),
        F.col("total_qty").alias("demand"),
        (F.col("avg_price") * F.col("total_qty")).alias("revenue"),
        simple_seasonal(doy).alias("seasonal"),
        *keep,
    )
