"""Histories, moving averages and other ordered calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pricing as P
from ..functions.numbers import clip


def _ordered(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


# The frames below run per episode or per daily series, whose length is the episode
# length or the calendar span.


def demand_trend(rows: DataFrame, keys: list[str], order: str, units: str = "units_sold", history: int = 7) -> DataFrame:
    """Mean of the last ``history`` sales against base demand; the history starts full of base demand."""
    frame = _ordered(keys, order).rowsBetween(-(history - 1), 0)
    seen, total = F.count("*").over(frame), F.sum(units).over(frame)
    mean = (total + (F.lit(history) - seen) * F.col("base_demand")) / F.lit(float(history))
    return rows.withColumn("demand_trend", P.demand_trend(mean, F.col("base_demand")))


def price_momentum(rows: DataFrame, keys: list[str], order: str, price: str = "price", history: int = 3) -> DataFrame:
    """Newest less oldest of the last ``history`` prices; the history starts full of the base price."""
    oldest = F.coalesce(F.lag(price, history - 1).over(_ordered(keys, order)), F.col("base_price"))
    return rows.withColumn("price_momentum", P.price_momentum(F.col(price), oldest, F.col("base_price")))


def previous_price(rows: DataFrame, keys: list[str], order: str, price: str = "price") -> DataFrame:
    before = F.lag(price, 1).over(_ordered(keys, order))
    return rows.withColumn("prev_price", F.coalesce(before, F.col("base_price")))


def running_revenue(rows: DataFrame, keys: list[str], order: str, revenue: str = "revenue") -> DataFrame:
    frame = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_revenue", F.sum(revenue).over(frame))


def price_walk(rows: DataFrame, keys: list[str], order: str, noise: str = "noise") -> DataFrame:
    """Running price: base plus a tenth of the summed noise, kept within the price bounds."""
    frame = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = P.price_bounds(F.col("base_price"), digits=None)
    walk = F.col("base_price") + F.sum(noise).over(frame) * F.lit(0.1)
    return rows.withColumn("price", clip(walk, low, high))


# Learning curves can be long and one product can own most of them, so the frames
# below are cut into blocks.  ``position`` must count 0, 1, 2, ... within the keys.


def _in_blocks(curve: DataFrame, keys: list[str], position: str, window: int, block: int):
    """Rows copied into each block whose frames need them: own block plus the ``window - 1`` before it."""
    own = F.floor(F.col(position) / F.lit(block)).cast("bigint")
    needed_by_next = F.pmod(F.col(position), F.lit(block)) >= F.lit(block - window + 1)
    blocks = F.when(needed_by_next, F.array(own, own + 1)).otherwise(F.array(own))
    rows = curve.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    return rows, Window.partitionBy(*keys, "_block").orderBy(position)


def moving_average(
    curve: DataFrame, keys: list[str], position: str, value: str, window: int = 20, block: int | None = None
) -> DataFrame:
    """Moving average over full windows only; a curve shorter than the window is kept as it is.

    Adds ``smoothed`` and the plotting coordinate ``x`` (the window start shifted by
    half a window).
    """
    block = max(block or 50 * window, window)
    rows, order = _in_blocks(curve, keys, position, window, block)
    # A curve is shorter than the window exactly if its first block is.
    first_size = F.count("*").over(Window.partitionBy(*keys, "_block"))
    short = (F.col("_block") == 0) & (F.col("_size") < window)
    averaged = (
        rows.withColumn("_mean", F.avg(value).over(order.rowsBetween(-(window - 1), 0)))
        .withColumn("_size", first_size)
        .filter(F.col("_block") == F.col("_own"))
        .withColumn("_short", short)
        .filter(F.col("_short") | (F.col(position) >= window - 1))
    )
    x = F.when(F.col("_short"), F.col(position)).otherwise(F.col(position) - F.lit(window - 1)) + F.lit(window // 2)
    return (
        averaged.withColumn("smoothed", F.when(F.col("_short"), F.col(value)).otherwise(F.col("_mean")))
        .withColumn("x", x.cast("bigint"))
        .drop("_own", "_block", "_mean", "_size", "_short")
    )


def smoothed_curve(curve: DataFrame, keys: list[str], position: str, value: str, window: int = 30) -> DataFrame:
    """Moving average with the best smoothed value of each curve beside it."""
    smooth = moving_average(curve, keys, position, value, window)
    best = smooth.groupBy(*keys).agg(F.max("smoothed").alias("best_smoothed"))
    return smooth.join(best, keys)


def trailing_averages(curve: DataFrame, keys: list[str], position: str, value: str, every: int = 100) -> DataFrame:
    """Average of the last ``every`` values at each ``every``-th one.

    The reporting points tile the curve, so this is a plain aggregate: each value
    belongs to exactly one tile, and only full tiles are reported.
    """
    tile = F.floor(F.col(position) / F.lit(every)).cast("bigint")
    return (
        curve.groupBy(*keys, tile.alias("_tile"))
        .agg(F.avg(value).alias("trailing_mean"), F.count("*").alias("_n"))
        .filter(F.col("_n") == every)
        .withColumn(position, (F.col("_tile") + 1) * F.lit(every))
        .drop("_tile", "_n")
    )


def newest_rows(rows: DataFrame, keys: list[str], seq: str, capacity: int = 20_000) -> DataFrame:
    """The ``capacity`` newest rows per key; ``seq`` is a unique integer within the key.

    Rows are first counted in blocks of ``capacity`` sequence numbers.  Blocks that
    start beyond the capacity are dropped by a join on (key, block), and only what
    is left (less than two capacities per key) is ranked.
    """
    block = F.floor(F.col(seq) / F.lit(capacity)).cast("bigint")
    blocked = rows.withColumn("_block", block)
    newer = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_size"))
        .withColumn("_newer", F.coalesce(F.sum("_size").over(newer), F.lit(0)))
        .filter(F.col("_newer") < capacity)
        .select(*keys, "_block")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return (
        blocked.join(kept, [*keys, "_block"], "left_semi")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= capacity)
        .drop("_block", "_rank")
    )
