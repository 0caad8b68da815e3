"""Elasticity kept up to date as days come in.

Per product and month the moments of log price and log quantity are stored: number, means, squared and mixed deviations, and the
extremes.  They merge without the points.  The fit leaves out points beyond some deviations of the product's mean, and
that bound moves with new days: months whose extremes lie inside it count by their moments, only the others
are read again.  Only products that got new days are fitted again.  Each update is a new version of the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import clip
from ..params import FitParams
from ..session import write_once
from ..sources import versions

_MONTH = ["StockCode", "month"]


def monthly_moments(daily: DataFrame) -> DataFrame:
    """Moments per product and month of the days with a positive price and quantity."""
    points = daily.filter((F.col("avg_price") > 0) & (F.col("total_qty") > 0)).select(
        "StockCode", F.trunc("Date", "month").alias("month"), "avg_price", "total_qty", F.ln("avg_price").alias("x"), F.ln("total_qty").alias("y")
    )
    n = F.count("*")
    return points.groupBy(*_MONTH).agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"), (F.covar_pop("x", "y") * n).alias("sxy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.sum("avg_price").alias("price"), F.sum("total_qty").alias("qty"),
    )


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of rows that share ``keys``."""
    group = Window.partitionBy(*keys)
    total = F.sum("n").over(group)
    rows = parts.withColumn("_mx", F.sum(F.col("n") * F.col("mx")).over(group) / total).withColumn("_my", F.sum(F.col("n") * F.col("my")).over(group) / total)
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"),
        F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.sum("price").alias("price"), F.sum("qty").alias("qty"),
    )


def fits_of(moments: DataFrame, daily: DataFrame, params: FitParams = FitParams()) -> DataFrame:
    """The rows of ``fit_elasticity`` for the products in ``moments``; ``daily`` is read for months that straddle a bound."""
    whole = merged_moments(moments, ["StockCode"]).filter(F.col("n") >= params.min_days)
    half_x, half_y = (F.lit(params.sigma) * F.sqrt(F.col(s) / F.col("n")) for s in ("sxx", "syy"))
    bounds = write_once(
        whole.select(
            "StockCode", F.col("n").alias("n_points"), (F.col("price") / F.col("n")).alias("base_price"), (F.col("qty") / F.col("n")).alias("base_demand"),
            F.col("mx").alias("cx"), F.col("my").alias("cy"), half_x.alias("hx"), half_y.alias("hy"),
            ((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).alias("varied"),
        ),
        "fit-bounds",
    )

    def inside(x: Column, y: Column) -> Column:
        return (F.abs(x - F.col("cx")) < F.col("hx")) & (F.abs(y - F.col("cy")) < F.col("hy"))

    months = moments.join(bounds.filter("varied"), "StockCode")
    kept = inside(F.col("x0"), F.col("y0")) & inside(F.col("x1"), F.col("y1"))
    within = months.filter(kept).select(moments.columns)
    torn = months.filter(~kept).select(*_MONTH, "cx", "cy", "hx", "hy")
    days = daily.withColumn("month", F.trunc("Date", "month")).join(torn, _MONTH)
    usable = (F.col("avg_price") > 0) & (F.col("total_qty") > 0)
    again = monthly_moments(days.filter(usable & inside(F.ln("avg_price"), F.ln("total_qty"))).select(daily.columns))
    slopes = merged_moments(within.unionByName(again), ["StockCode"]).select(
        "StockCode", F.when((F.col("sxx") > 0) & (F.col("n") > 1), F.col("sxy") / F.col("sxx")).alias("slope")
    )
    flat, few = F.coalesce("slope", F.lit(0.0)), F.col("n_points") < params.min_points
    return bounds.join(slopes, "StockCode", "left").select(
        "StockCode",
        F.when(few, F.lit(params.fallback)).otherwise(clip(flat, params.low, params.high)).alias("elasticity"),
        "base_demand",
        "base_price",
        "n_points",
        (~few & ((flat < params.low) | (flat > params.high))).alias("clipped"),
    )


def current_fits(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{versions.current(spark, directory)['folder']}/fits")


def update_fits(new_days: DataFrame, directory: str, params: FitParams = FitParams()) -> dict:
    """Add days that are not in the state yet, fit their products again, and make that the current version.

    Days, moments and fits are stored in ``directory``.  Days are kept in a folder per update that later versions
    go on reading, so an update writes its own days only.
    """
    spark = new_days.sparkSession
    before = versions.current(spark, directory)
    own = new_days.select("StockCode", "Date", "avg_price", "total_qty")

    def write(folder: str) -> dict:
        own.write.parquet(f"{folder}/days")
        folders = [*(before["days"] if before else []), folder.removeprefix(f"{directory}/") + "/days"]
        daily = spark.read.schema(own.schema).parquet(*[f"{directory}/{f}" for f in folders])
        fresh = monthly_moments(spark.read.schema(own.schema).parquet(f"{folder}/days"))
        if before:
            stored = spark.read.parquet(f"{directory}/{before['folder']}/moments")
            fresh = merged_moments(stored.unionByName(fresh), _MONTH)
        fresh.write.parquet(f"{folder}/moments")
        moments = spark.read.parquet(f"{folder}/moments")
        touched = spark.read.schema(own.schema).parquet(f"{folder}/days").select("StockCode").distinct()
        fits = fits_of(moments.join(touched, "StockCode", "left_semi"), daily, params)
        if before:
            others = spark.read.parquet(f"{directory}/{before['folder']}/fits").join(touched, "StockCode", "left_anti")
            fits = others.unionByName(fits)
        fits.write.parquet(f"{folder}/fits")
        return {"days": folders, "products": touched.count()}

    return versions.commit(spark, directory, write)
