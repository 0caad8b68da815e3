"""The ten-feature observation table over step logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..params import EpisodeParams
from .windows import demand_trend, price_momentum

EPISODE_KEYS = ["product_id", "policy", "episode"]

FEATURES = (
    "price_ratio",
    "inventory_ratio",
    "dow_sin",
    "dow_cos",
    "season_signal",
    "demand_trend",
    "price_momentum",
    "elasticity_signal",
    "stockout_risk",
    "category_signal",
)


def calendar_features(rows: DataFrame, dow: str = "day_of_week", doy: str = "day_of_year") -> DataFrame:
    return (
        rows.withColumn("dow_sin", P.week_sin(F.col(dow)))
        .withColumn("dow_cos", P.week_cos(F.col(dow)))
        .withColumn("season_signal", P.year_sin(F.col(doy)))
    )


def _feature_columns(keys: list[str], params: EpisodeParams) -> list:
    return [
        *keys,
        "step",
        P.price_ratio(F.col("price"), F.col("base_price")).alias("price_ratio"),
        P.inventory_ratio(F.col("inventory"), params.max_inventory).alias("inventory_ratio"),
        "dow_sin",
        "dow_cos",
        "season_signal",
        "demand_trend",
        "price_momentum",
        P.elasticity_signal(F.col("elasticity")).alias("elasticity_signal"),
        P.stockout_risk(F.col("inventory"), params.max_inventory).alias("stockout_risk"),
        P.category_signal(F.col("category")).alias("category_signal"),
    ]


def observations(
    steps: DataFrame, catalogue: DataFrame, params: EpisodeParams = EpisodeParams(), keys: list[str] | None = None
) -> DataFrame:
    """Features after each step of any step log: next day's calendar, the price and stock the step left behind.

    Both histories use the same window partitioning, so they share one shuffle.
    """
    keys = keys or EPISODE_KEYS
    product = catalogue.select("product_id", "base_price", "base_demand", "elasticity", "category")
    rows = steps.drop("base_price", "base_demand", "elasticity", "category").join(product, "product_id")
    rows = demand_trend(rows, keys, "step", "units_sold", params.demand_history)
    rows = price_momentum(rows, keys, "step", "price", params.price_history)
    rows = calendar_features(rows, "next_day_of_week", "next_day_of_year")
    return rows.select(*_feature_columns(keys, params))


def observations_of_log(steps: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """The same for logged episodes, whose rows hold both histories and the product's figures: no join, no window."""
    rows = steps.withColumn("demand_trend", F.col("trend")).withColumn(
        "price_momentum", P.price_momentum(F.col("price"), F.col("oldest_price"), F.col("base_price"))
    )
    rows = calendar_features(rows, "next_day_of_week", "next_day_of_year")
    return rows.select(*_feature_columns(EPISODE_KEYS, params))


def feature_vector(rows: DataFrame, name: str = "features") -> DataFrame:
    """The ten features as one array, for use at a model boundary."""
    return rows.withColumn(name, F.array(*[F.col(c) for c in FEATURES]))
