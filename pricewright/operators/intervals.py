"""How sure the evaluation of policies is: a Poisson bootstrap over episodes.

In each replicate an episode counts 0, 1, 2, ... times with the odds of a Poisson distribution of mean one, drawn from a repeatable
hash of product, episode and replicate.  Weighted sums are combined map-side, so an episode costs its replicates in arithmetic
and nothing in shuffled rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import mixed_unit, product_number, with_episode_hash, with_step_unit

REPLICATES = 100
# Odds of at most 0, 1, 2, ... for a mean of one; a weight stops at their number.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)), 9) for n in range(8))


def weight_at(u: Column) -> Column:
    """How often an episode counts whose draw is ``u``."""
    return sum((F.when(u >= limit, 1).otherwise(0) for limit in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))


def weight(product_id: Column, episode: Column, replicate: Column, seed: int = 17) -> Column:
    """How often an episode counts in a replicate."""
    return weight_at(mixed_unit(product_number(product_id), episode, replicate, seed))


def replicated_means(totals: DataFrame, replicates: int = REPLICATES, seed: int = 17, value: str = "total_reward") -> DataFrame:
    """``policy, product_id, replicate, mean``; no row where a replicate drew none of a product's episodes.

    The weights are those of ``weight``, worked out in steps that each are a column: what depends on the episode alone
    once for all its replicates, and no part twice.  Episodes of weight zero fall out of the sums, not by a filter, which
    would work the weights out once more.
    """
    rows = totals.select("policy", "product_id", "episode", F.col(value).alias("value"))
    drawn = with_episode_hash(rows, product_number(F.col("product_id")), F.col("episode"), seed)
    drawn = drawn.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_step_unit(drawn, F.col("replicate"), "_u").withColumn("_w", weight_at(F.col("_u")))
    sums = drawn.groupBy("policy", "product_id", "replicate").agg(
        F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("value"))).alias("_values"), F.sum("_w").alias("_weights")
    )
    return sums.filter("_weights > 0").select("policy", "product_id", "replicate", (F.col("_values") / F.col("_weights")).alias("mean"))


def _ends(means: Column, share: float) -> list[Column]:
    """The bounds that leave ``share`` of the replicates out at each end."""
    ordered, n = F.array_sort(F.collect_list(means)), F.count(means)
    out = F.floor(n * F.lit(share))
    return [F.element_at(ordered, (out + 1).cast("int")).alias("low"), F.element_at(ordered, (n - out).cast("int")).alias("high")]


def product_intervals(means: DataFrame, share: float = 0.05) -> DataFrame:
    """Bounds of the mean reward per policy and product; a list holds one number a replicate."""
    return means.groupBy("policy", "product_id").agg(*_ends(F.col("mean"), share), F.count("*").alias("n_replicates"))


def policy_intervals(means: DataFrame, share: float = 0.05) -> DataFrame:
    """Bounds of each policy's mean over products, how often it comes first, and its mean rank, over all replicates."""
    pooled = means.groupBy("policy", "replicate").agg(F.avg("mean").alias("mean"))
    # A row per policy in each group.
    place = F.row_number().over(Window.partitionBy("replicate").orderBy(F.col("mean").desc(), "policy"))
    return (
        pooled.withColumn("place", place)
        .groupBy("policy")
        .agg(*_ends(F.col("mean"), share), F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)).alias("first_share"), F.avg("place").alias("mean_rank"))
    )
