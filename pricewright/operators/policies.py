"""Pricing policies.

An ``OpenLoop`` gives the level as a Column of product, episode and step.  The rule policy
depends on the demand trend alone, so it follows a logged trend.  Learned tables hold one level
per state bucket and product (see ``learning``).

An external model scores feature rows in Arrow batches with ``model_policy``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions.numbers import clip, let, mixed_hash, product_number
from ..params import EpisodeParams


@dataclass(frozen=True)
class OpenLoop:
    """``level(product, episode, step)`` gives the price level of a step.

    ``constant`` says that the level does not depend on the step, so that it is
    worked out once per episode.
    """

    name: str
    level: Callable[[Callable[[str], Column], Column, Column], Column]
    constant: bool = False


def fixed_policy(params: EpisodeParams = EpisodeParams()) -> OpenLoop:
    """Always the level nearest to the base price."""

    def level(product, episode, step):
        grid = P.price_grid(product("price_min"), product("price_max"), params.price_levels)
        return P.nearest_level(grid, product("base_price"))

    return OpenLoop("fixed", level, constant=True)


def optimal_policy(params: EpisodeParams = EpisodeParams()) -> OpenLoop:
    """Always the level nearest to the revenue-maximising price, kept on the grid."""

    def level(product, episode, step):
        grid = P.price_grid(product("price_min"), product("price_max"), params.price_levels)
        best = P.revenue_maximising_price(product("base_price"), product("elasticity"))
        return P.nearest_level(grid, clip(best, product("price_min"), product("price_max")))

    return OpenLoop("optimal", level, constant=True)


def random_policy(params: EpisodeParams = EpisodeParams(), name: str = "random") -> OpenLoop:
    """A repeatable pseudo-random level per product, episode and step."""

    def level(product, episode, step):
        drawn = mixed_hash(product_number(product("product_id")), episode, step + F.lit(1), params.seed)
        return F.pmod(drawn, F.lit(params.price_levels)).cast("int")

    return OpenLoop(name, level)


def rule_step(level: Column, trend: Column, threshold: float, top: int) -> Column:
    up = F.least(level + F.lit(1), F.lit(top))
    down = F.greatest(level - F.lit(1), F.lit(0))
    return F.when(trend > threshold, up).when(trend < -threshold, down).otherwise(level)


def with_policies(products: DataFrame, names: list[str]) -> DataFrame:
    """Every product under every policy.  The list is a literal, so nothing is joined."""
    return products.withColumn("policy", F.explode(F.array(*[F.lit(n) for n in names])))


def with_price_levels(products: DataFrame, levels: int = 11) -> DataFrame:
    """Every product at every price level."""
    grid = P.price_grid(F.col("price_min"), F.col("price_max"), levels)
    return products.select("*", F.posexplode(grid).alias("level", "price"))


def planned_levels(products: DataFrame, policies: list[OpenLoop], episodes: int, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Level of every step under open-loop policies, without running the episodes."""
    rows = products.withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(episodes - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(params.episode_len - 1)))
    )
    plans = [
        F.struct(F.lit(p.name).alias("policy"), p.level(F.col, F.col("episode"), F.col("step")).alias("action"))
        for p in policies
    ]
    return rows.select("product_id", "episode", "step", F.inline(F.array(*plans)))


def rule_levels(trends: DataFrame, keys: list[str], order: str, trend: str = "trend", params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Rule policy over logged demand trends: a fold, because the level is clamped at every step.

    A key is one episode, so its array is as long as the episode.
    """
    top = params.price_levels - 1
    start = F.struct(
        F.lit(params.price_levels // 2).alias("level"), F.array().cast("array<int>").alias("levels")
    )

    def step(acc, row):
        moved = rule_step(acc["level"], row["trend"], params.trend_threshold, top)
        return let(
            moved, acc, lambda level: F.struct(level.alias("level"), F.array_append(acc["levels"], level).alias("levels"))
        )

    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(trend).alias("trend"))))
    return (
        trends.groupBy(*keys)
        .agg(rows.alias("_rows"))
        .withColumn("_levels", F.aggregate("_rows", start, step, lambda acc: acc["levels"]))
        .select(*keys, F.inline_outer(F.arrays_zip(F.col("_rows.at").alias(order), F.col("_levels").alias("action"))))
    )


def model_policy(score: Callable[[pd.Series], pd.Series]):
    """Wrap an external model as a Column function over the ten-feature array.

    ``score`` gets a pandas Series of feature vectors (one Arrow batch) and returns
    one integer level per row.
    """

    @F.pandas_udf("int")
    def choose(features: pd.Series) -> pd.Series:
        return score(features)

    return choose
