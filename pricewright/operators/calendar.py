"""Date spines, expected series, and the calendar rows an episode runs over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pricing as P
from ..functions.numbers import mixed_hash, product_number
from ..params import EpisodeParams


def date_spine(products: DataFrame, start: str, n_days: int) -> DataFrame:
    """``n_days`` consecutive days per product from its date column ``start``."""
    last = F.date_add(F.col(start), n_days - 1)
    days = F.sequence(F.col(start), last, F.expr("interval 1 day"))
    return products.select("*", F.posexplode(days).alias("t", "date"))


def expected_series(products: DataFrame, start: str = "start_date", n_days: int = 1095, prices: DataFrame | None = None) -> DataFrame:
    """Demand and revenue the model expects at given prices, without a random draw.

    ``products`` carries ``base_price, base_demand, elasticity`` and the season
    columns ``weekly_amp, annual_amp, annual_peak, trend_rate``.  ``prices``
    (``product_id, date, price``) overrides the base price day by day.
    """
    spine = date_spine(products, start, n_days)
    if prices is None:
        spine = spine.withColumn("price", F.col("base_price"))
    else:
        spine = spine.join(prices.select("product_id", "date", "price"), ["product_id", "date"], "left").withColumn(
            "price", F.coalesce("price", "base_price")
        )
    seasonal = P.seasonal_factor(
        F.col("t"), F.col("weekly_amp"), F.col("annual_amp"), F.col("annual_peak"), F.col("trend_rate")
    )
    demand = P.unclamped_demand(
        F.col("base_demand"), F.col("seasonal"), F.col("price"), F.col("base_price"), F.col("elasticity")
    )
    return (
        spine.withColumn("seasonal", seasonal)
        .withColumn("demand", demand)
        .select(
            "product_id",
            "date",
            P.day_of_week(F.col("date")).alias("day_of_week"),
            P.day_of_year(F.col("date")).alias("day_of_year"),
            "price",
            "demand",
            (F.col("price") * F.col("demand")).alias("revenue"),
            "seasonal",
        )
    )


def custom_series(products: DataFrame, noise=None, start: str = "2023-01-01", n_days: int = 365, noise_size: float = 0.05) -> DataFrame:
    """Constant-price series of user-registered products.

    ``noise(product_id, day_index)`` returns the standard draw of a day as a
    Column; without it the series is the expected one.  Days count from 1.
    """
    z = noise(F.col("product_id"), F.col("t")) if noise else F.lit(0.0)
    spine = date_spine(products.withColumn("_start", F.lit(start).cast("date")), "_start", n_days)
    seasonal = P.simple_seasonal(F.col("t") + 1)
    rows = spine.withColumn("seasonal", seasonal).withColumn(
        "demand",
        F.greatest(F.lit(0.0), F.col("base_demand") * F.col("seasonal") * (F.lit(1.0) + F.lit(noise_size) * z)),
    )
    return rows.select(
        "product_id",
        "date",
        P.day_of_week(F.col("date")).alias("day_of_week"),
        (F.col("t") + 1).cast("int").alias("day_of_year"),
        F.col("base_price").alias("price"),
        "demand",
        (F.col("demand") * F.col("base_price")).alias("revenue"),
        "seasonal",
    )


def with_row_index(series: DataFrame) -> DataFrame:
    """Row number from 0 in date order and the row count, per product."""
    group = Window.partitionBy("product_id")
    return series.withColumn("row_index", F.row_number().over(group.orderBy("date")) - 1).withColumn(
        "n_rows", F.count("*").over(group).cast("int")
    )


def attach_calendar(
    steps: DataFrame, series: DataFrame, start: str | Callable[[Column], Column] = "start", offset: str = "offset"
) -> DataFrame:
    """Calendar row of each step: row ``start + offset``, or the last one beyond the end.

    ``start`` is a column, or makes one from the length of the product's calendar.  Lengths and rows come from one
    numbered calendar, so they share its exchange.
    """
    indexed = with_row_index(series)
    lengths = indexed.filter("row_index = 0").select("product_id", "n_rows")
    first = start(F.col("n_rows")) if callable(start) else F.col(start)
    wanted = steps.join(lengths, "product_id").withColumn("row_index", F.least(first + F.col(offset), F.col("n_rows") - 1).cast("int"))
    return wanted.join(indexed.drop("n_rows"), ["product_id", "row_index"])


def episode_start(n_rows, product_no, episode, params: EpisodeParams = EpisodeParams()):
    """Repeatable start row in ``[0, max(1, n_rows - episode_len - 1))``.

    The last start that would still fit is left out on purpose.
    """
    span = F.greatest(F.lit(1), n_rows - F.lit(params.episode_len + 1))
    return F.pmod(mixed_hash(product_no, episode, F.lit(0), params.seed), span).cast("int")


def calendar_array(date: Column, seasonal: Column, dow: Column, doy: Column) -> Column:
    """Aggregate: the days of a product as a date-ordered array.

    There is one row per product and calendar day, so an array is as long as the span
    of dates (a few thousand entries), whatever the number of transactions behind it.
    """
    day = F.struct(date.alias("date"), seasonal.alias("seasonal"), dow.alias("day_of_week"), doy.alias("day_of_year"))
    return F.array_sort(F.collect_list(day)).alias("calendar")


def product_calendars(series: DataFrame) -> DataFrame:
    """One row per product with its calendar as a date-ordered array."""
    columns = [F.col(c) for c in ("date", "seasonal", "day_of_week", "day_of_year")]
    return series.groupBy("product_id").agg(calendar_array(*columns))


def episode_slices(calendars: DataFrame, episodes: int, params: EpisodeParams = EpisodeParams(), block: int = 100) -> DataFrame:
    """Cut ``episodes`` slices per product out of its calendar.

    A slice has one day more than the episode: the observation after the last step
    looks at the next day.  Beyond the end of the calendar the last day repeats.
    Slices are cut ``block`` episodes at a time before they become rows, so the whole
    calendar is copied once per block and not once per episode.
    """
    calendar, last = F.col("calendar"), F.size("calendar") - F.lit(1)
    number = product_number(F.col("product_id"))

    def begun(episode: Column) -> Column:
        start = episode_start(F.size("calendar"), number, episode, params)
        return F.struct(episode.alias("episode"), start.alias("start"))

    def cut(e: Column) -> Column:
        at = F.sequence(F.lit(0), F.lit(params.episode_len))
        days = F.transform(at, lambda i: calendar[F.least(e["start"] + i, last)])
        return F.struct(e["episode"].alias("episode"), e["start"].alias("start"), days.alias("days"))

    firsts = F.sequence(F.lit(0), F.lit(episodes - 1), F.lit(block))
    numbers = F.sequence(F.col("_first"), F.least(F.col("_first") + (block - 1), F.lit(episodes - 1)))
    rows = calendars.withColumn("_first", F.explode(firsts)).withColumn(
        "_slices", F.transform(F.transform(numbers, begun), cut)
    )
    kept = [c for c in calendars.columns if c != "calendar"]
    return rows.select(*kept, F.size("calendar").alias("n_rows"), "_slices").select(
        *kept, "n_rows", F.inline_outer("_slices")
    )


def episode_days(series: DataFrame, episodes: int, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """The calendar rows of the episodes, one row per product, episode and step."""
    slices = episode_slices(product_calendars(series), episodes, params)
    return slices.select(
        "product_id", "episode", "start", F.posexplode_outer(F.slice("days", 1, params.episode_len)).alias("step", "day")
    ).select("product_id", "episode", "start", "step", "day.*")
