"""Roll-ups of episodes: totals, policy evaluation, leaderboard, learning log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up

EPISODE_KEYS = ["product_id", "policy", "episode"]


def episode_totals(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per episode of any step log."""
    return steps.groupBy(*(keys or EPISODE_KEYS)).agg(
        F.sum("reward").alias("total_reward"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("price").alias("price_sum"),
        F.count("*").alias("n_steps"),
    )


def evaluate_policies(totals: DataFrame) -> DataFrame:
    """Mean and population deviation of episode rewards per policy and product.

    The average price is taken over steps, not over episodes; the mean revenue is
    real revenue.
    """
    return totals.groupBy("policy", "product_id").agg(
        F.avg("total_reward").alias("mean_reward"),
        F.stddev_pop("total_reward").alias("std_reward"),
        F.avg("total_revenue").alias("mean_revenue"),
        (F.sum("price_sum") / F.sum("n_steps")).alias("avg_price"),
        F.count("*").alias("n_episodes"),
    )


def summarise_policies(evaluation: DataFrame) -> DataFrame:
    """Mean of product means and mean of product deviations per policy."""
    return evaluation.groupBy("policy").agg(
        F.avg("mean_reward").alias("mean_reward"), F.avg("std_reward").alias("std_reward")
    )


def leaderboard(summary: DataFrame) -> DataFrame:
    """Best mean reward first.  The table has one row per policy, so one task ranks it."""
    order = [F.col("mean_reward").desc(), F.col("policy").asc()]
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy(*order)


def task_batch_stats(totals: DataFrame, iteration: str = "iteration", reward: str = "total_reward") -> DataFrame:
    return totals.groupBy(iteration).agg(
        F.avg(reward).alias("mean_reward"), F.min(reward).alias("min_reward"), F.max(reward).alias("max_reward")
    )


def learning_log(totals: DataFrame) -> DataFrame:
    """Reward and revenue history per product and policy, in episode order."""
    return totals.select(
        "product_id", "policy", "episode", F.col("total_reward").alias("reward"), F.col("total_revenue").alias("revenue")
    ).orderBy("product_id", "policy", "episode")


def benchmark_report(evaluation: DataFrame, digits: int = 3) -> DataFrame:
    """Rounded mean and deviation per policy and product, with the number of episodes."""
    return evaluation.select(
        "product_id",
        "policy",
        half_up(F.col("mean_reward"), digits).alias("mean"),
        half_up(F.col("std_reward"), digits).alias("std"),
        F.col("n_episodes").alias("n_eval"),
    )


def step_log_report(steps: DataFrame) -> DataFrame:
    """Totals of an episode as shown to users: reward at 4 digits, revenue summed from rounded steps."""
    return steps.groupBy(*EPISODE_KEYS).agg(
        half_up(F.sum("reward"), 4).alias("total_reward"),
        half_up(F.sum(half_up(F.col("revenue"), 2)), 2).alias("total_revenue"),
        F.count("*").alias("n_steps"),
    )


def matched_evaluation(steps: DataFrame, best: DataFrame, keys: list[str], default_level: int = 5) -> DataFrame:
    """How a learned policy would have done, judged on logged steps alone.

    ``steps`` has ``state, action, reward``; ``best`` has an ``action`` per ``keys`` and state, and states
    it lacks get ``default_level``.  Steps whose logged action is the policy's own
    stand for the policy; a policy none of whose actions was logged has a null reward.
    """
    learned = best.select(*keys, "state", F.col("action").alias("learned"))
    rows = steps.join(learned, [*keys, "state"], "left")
    same = F.coalesce("learned", F.lit(default_level)) == F.col("action")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.count_if(same).alias("n_matched"),
        F.avg(F.when(same, F.col("reward"))).alias("matched_reward"),
        F.avg("reward").alias("logged_reward"),
    )


def off_policy_evaluation(steps: DataFrame, best: DataFrame, model: DataFrame, keys: list[str], default_level: int = 5) -> DataFrame:
    """What a policy would have earned per step, from steps that another one priced.

    ``steps`` has ``state, action, reward``; ``best`` the policy's action per ``keys`` and state (``default_level`` where it has
    none); ``model`` an expected reward ``q`` per ``keys``, state and action (their mean where it has none).  The odds of an action
    in a state are its share of the logged steps there.  A step that agrees weighs one over its odds, any other nothing:

    - ``weighted_reward`` is the weighted mean reward,
    - ``model_reward`` what the model expects of the policy,
    - ``corrected_reward`` the model's figure plus the weighted mean of its errors, which stays right if either of the two is,
    - ``effective_steps`` how many steps of equal weight the weights are worth.

    Every key has a row; ``reason`` says why figures are missing: ``no_model`` without learning steps, ``no_agreement`` where no
    logged step agrees (``model_reward`` alone is given then).
    """
    cell = [*keys, "state", "action"]
    # Sums per logged cell: nothing below has more rows than states times actions per key.
    cells = steps.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("reward").alias("rewards"))
    learned = best.select(*keys, "state", F.col("action").alias("learned"))
    expected = model.select(*cell, F.col("q").alias("own_q"))
    chosen = model.select(*keys, "state", F.col("action").alias("learned"), F.col("q").alias("learned_q"))
    usual = model.groupBy(*keys).agg(F.avg("q").alias("usual_q"))
    rows = (
        cells.join(learned, [*keys, "state"], "left")
        .withColumn("learned", F.coalesce("learned", F.lit(default_level)))
        .join(expected, cell, "left")
        .join(chosen, [*keys, "state", "learned"], "left")
        .join(usual, keys, "left")
        .withColumn("own_q", F.coalesce("own_q", "usual_q"))
        .withColumn("learned_q", F.coalesce("learned_q", "usual_q"))
        .withColumn("in_state", F.sum("n").over(Window.partitionBy(*keys, "state")))
    )
    agrees, odds = F.col("action") == F.col("learned"), F.col("n") / F.col("in_state")
    total = F.sum(F.when(agrees, F.col("n") / odds))
    error = F.sum(F.when(agrees, (F.col("rewards") - F.col("n") * F.col("own_q")) / odds)) / total
    expected_reward = F.sum(F.col("n") * F.col("learned_q")) / F.sum("n")
    figures = rows.groupBy(*keys).agg(
        F.sum("n").alias("n_steps"),
        F.coalesce(F.sum(F.when(agrees, F.col("n"))), F.lit(0)).alias("n_agreeing"),
        (F.sum("rewards") / F.sum("n")).alias("logged_reward"),
        (F.sum(F.when(agrees, F.col("rewards") / odds)) / total).alias("weighted_reward"),
        expected_reward.alias("model_reward"),
        (expected_reward + error).alias("corrected_reward"),
        (total * total / F.sum(F.when(agrees, F.col("n") / (odds * odds)))).alias("effective_steps"),
    )
    unknown = F.when(F.col("model_reward").isNull(), "no_model").when(F.col("n_agreeing") == 0, "no_agreement")
    return figures.withColumn("reason", unknown.otherwise("none"))


def full_benchmark(steps: DataFrame) -> DataFrame:
    """From logged steps to the leaderboard of their policies."""
    return leaderboard(summarise_policies(evaluate_policies(episode_totals(steps))))
