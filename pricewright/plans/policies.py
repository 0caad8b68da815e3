"""Registered queries: ledger, policies, logged episodes and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import evaluate as E
from ..operators import episodes as episodes_
from ..operators import features, policies, stateful
from ..operators import intervals as I
from ..operators.ledger import stock_ledger as stock_ledger_of
from ..operators.ledger_scan import stock_ledger_scan
from ..operators.windows import running_revenue
from . import base as B
from .registry import cte, query
from .sql import TWO_PI, clip, level_price, mixed_hash, nearest, optimal_price, rnd, unit, whole

P = B.TIGHT

# --- the logged episodes in SQL -------------------------------------------------------

cte(
    "planned",
    f"""
    SELECT product_id, {nearest('base_price')} AS fixed_level,
           {nearest(clip(optimal_price(), 'price_min', 'price_max'))} AS optimal_level FROM described""",
)


def ledger_sql(most: int, restock: int) -> str:
    return f"""
    WITH RECURSIVE r AS (
      SELECT product_id, CAST(-1 AS BIGINT) AS step, {most}::BIGINT AS inventory, CAST(NULL AS DATE) AS date, 0e0 AS demand,
             0e0 AS price, 0::BIGINT AS units_sold, 0::BIGINT AS lost_units, {most}::BIGINT AS inventory_before
      FROM indexed WHERE row_index = 0
      UNION ALL
      SELECT r.product_id, i.row_index,
             least({most}, greatest(0, r.inventory - least({whole('i.demand')}, r.inventory)) + {restock}),
             i.date, i.demand, i.price, least({whole('i.demand')}, r.inventory),
             greatest(0, {whole('i.demand')} - r.inventory), r.inventory
      FROM r JOIN indexed i ON i.product_id = r.product_id AND i.row_index = r.step + 1
    )
    SELECT *, units_sold * price AS revenue,
           units_sold * price - 2e0 * lost_units - 0.001e0 * inventory_before AS raw_reward
    FROM r WHERE step >= 0"""


_TREND = clip("((total + (7 - seen) * base_demand) / 7e0) / (base_demand + 1e-8) - 1e0", "-2e0", "2e0")
_UNMOVED = clip("base_demand / (base_demand + 1e-8) - 1e0", "-2e0", "2e0")

cte("stock", ledger_sql(P.max_inventory, P.restock))
cte(
    "run",
    f"""
    WITH days AS (
      SELECT l.product_id, CAST(l.step // 30 AS INTEGER) AS episode, CAST(l.step // 30 * 30 AS INTEGER) AS start,
             CAST(count(*) OVER (PARTITION BY l.product_id) AS INTEGER) AS n_rows, CAST(l.step % 30 AS INTEGER) AS step,
             coalesce(lead(l.date) OVER (PARTITION BY l.product_id ORDER BY l.step), l.date) AS next_date, l.price, l.demand, l.units_sold, l.lost_units,
             l.revenue, l.raw_reward, l.inventory_before, l.inventory,
             d.base_price, d.base_demand, d.elasticity, {nearest('l.price')} AS action, {nearest('d.base_price')} AS listed
      FROM stock l JOIN described d ON d.product_id = l.product_id),
    moved AS (
      SELECT *, {_TREND} AS trend, raw_reward / greatest(1e0, base_demand * base_price) AS reward,
             CASE WHEN begun < listed THEN 'below_list' WHEN begun > listed THEN 'above_list' ELSE 'at_list' END AS policy
      FROM (SELECT *, count(*) OVER w AS seen, sum(units_sold) OVER w AS total,
                   first_value(action) OVER (PARTITION BY product_id, episode ORDER BY step) AS begun FROM days
            WINDOW w AS (PARTITION BY product_id, episode ORDER BY step ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))
    SELECT *, coalesce(lag(trend) OVER (PARTITION BY product_id, episode ORDER BY step), {_UNMOVED}) AS trend_before
    FROM moved""",
)
cte(
    "totals",
    """
    SELECT product_id, policy, episode, sum(reward) AS total_reward, sum(revenue) AS total_revenue,
           sum(price) AS price_sum, count(*) AS n_steps
    FROM run GROUP BY product_id, policy, episode""",
)
cte(
    "evaluation",
    """
    SELECT policy, product_id, avg(total_reward) AS mean_reward, stddev_pop(total_reward) AS std_reward,
           avg(total_revenue) AS mean_revenue, sum(price_sum) / sum(n_steps) AS avg_price, count(*) AS n_episodes
    FROM totals GROUP BY policy, product_id""",
)


def steps_of(spark, sf_dir):
    return episodes_.steps_of_days(B.priced(spark, sf_dir), P)


def totals_of(spark, sf_dir):
    return E.episode_totals(steps_of(spark, sf_dir))


# --- ledger and policies -------------------------------------------------------------

cte("ledger", ledger_sql(60, 15))


@query(
    "R6",
    f"""SELECT product_id, date, CAST(step AS INTEGER) AS step, {rnd('demand')} AS demand, {rnd('price')} AS price,
        units_sold, lost_units, {rnd('revenue')} AS revenue, {rnd('raw_reward')} AS raw_reward,
        inventory_before, inventory FROM ledger""",
)
def stock_ledger(spark, sf_dir):
    from ..params import EpisodeParams

    days = B.series(spark, sf_dir).select("product_id", "date", "demand", "price")
    small = EpisodeParams(max_inventory=60, restock=15)
    return B.rounded(stock_ledger_of(days, ["product_id"], "date", small))


@query(
    "R6",
    f"""SELECT product_id, date, CAST(step AS INTEGER) AS step, {rnd('demand')} AS demand, {rnd('price')} AS price,
        units_sold, lost_units, {rnd('revenue')} AS revenue, {rnd('raw_reward')} AS raw_reward,
        inventory_before, inventory FROM ledger""",
)
def stock_ledger_by_scan(spark, sf_dir):
    """The same ledger without gathering a product's days: stretches of days as three numbers each."""
    from ..params import EpisodeParams

    days = B.series(spark, sf_dir).select("product_id", "date", "demand", "price")
    small = EpisodeParams(max_inventory=60, restock=15)
    return B.rounded(stock_ledger_scan(days, ["product_id"], "date", small))


@query(
    "R7",
    f"""SELECT d.product_id, CAST(e AS INTEGER) AS episode, CAST(s AS INTEGER) AS step, policy,
        CAST(CASE policy WHEN 'fixed' THEN fixed_level WHEN 'optimal' THEN optimal_level
             ELSE {mixed_hash('d.product_id', 'e', '(s + 1)', 42)} % 11 END AS INTEGER) AS action
        FROM described d JOIN planned p ON p.product_id = d.product_id, range({B.EPISODES}) x(e), range(30) y(s),
             (VALUES ('fixed'), ('optimal'), ('random')) q(policy)""",
)
def open_loop_policy_actions(spark, sf_dir):
    chosen = [policies.fixed_policy(P), policies.optimal_policy(P), policies.random_policy(P)]
    return policies.planned_levels(B.catalogue(spark, sf_dir), chosen, B.EPISODES, P)


RULE = """WITH RECURSIVE g AS (
         SELECT product_id, episode, -1 AS step, 5 AS action FROM run WHERE step = 0
         UNION ALL
         SELECT g.product_id, g.episode, g.step + 1,
                CASE WHEN r.trend_before > 0.1e0 THEN least(g.action + 1, 10)
                     WHEN r.trend_before < -0.1e0 THEN greatest(g.action - 1, 0) ELSE g.action END
         FROM g JOIN run r ON r.product_id = g.product_id AND r.episode = g.episode
                          AND r.step = g.step + 1)
       SELECT product_id, episode, step, action FROM g WHERE step >= 0"""


@query("R8", RULE)
def rule_policy_actions(spark, sf_dir):
    return policies.rule_levels(steps_of(spark, sf_dir), ["product_id", "episode"], "step", "trend_before", P)


@query("P1, R8", RULE)
def stateful_policy_levels(spark, sf_dir):
    """The rule of thumb as an external policy that remembers its last level."""
    steps = steps_of(spark, sf_dir).select("product_id", "episode", "step", "trend_before")
    return stateful.stateful_levels(steps, ["product_id", "episode"], "step", stateful.rule_policy(P), B.tasks(spark, sf_dir))


STEP = f"""product_id, policy, episode, start, step, action, {rnd('price')} AS price, {rnd('demand')} AS demand,
    units_sold, lost_units, {rnd('revenue')} AS revenue, {rnd('raw_reward')} AS raw_reward, {rnd('reward')} AS reward,
    inventory_before, inventory, {rnd('trend_before')} AS trend_before, {rnd('trend')} AS trend"""


@query("R9", f"SELECT {STEP} FROM run")
def logged_episode_steps(spark, sf_dir):
    unshown = ("next_day_of_week", "next_day_of_year", "oldest_price", "n_rows", "category", *episodes_.FIGURES)
    return B.rounded(steps_of(spark, sf_dir).drop(*unshown))


@query(
    "R10, X22",
    f"""SELECT product_id, policy, episode, step + 1 AS day, {rnd('price', 4)} AS price, {rnd('demand', 2)} AS demand,
        units_sold, {rnd('revenue', 2)} AS revenue, inventory, {rnd('reward', 4)} AS reward
        FROM run WHERE product_id = '7'""",
)
def step_log_of_one_product(spark, sf_dir):
    return episodes_.rounded_step_log(episodes_.steps_of_days(C.find_product(B.priced(spark, sf_dir), 7), P))


@query(
    "R10",
    f"""SELECT product_id, policy, episode, {rnd('sum(reward)', 4)} AS total_reward,
        {rnd('sum(' + rnd('revenue', 2) + ')', 2)} AS total_revenue, count(*) AS n_steps
        FROM run GROUP BY product_id, policy, episode""",
)
def step_log_totals(spark, sf_dir):
    return E.step_log_report(steps_of(spark, sf_dir))


@query(
    "R13",
    f"""SELECT product_id, policy, episode, step + 1 AS day, {rnd('price')} AS price, {rnd('revenue')} AS revenue
        FROM run""",
)
def price_and_revenue_traces(spark, sf_dir):
    return B.rounded(episodes_.price_traces(steps_of(spark, sf_dir)))


FEATURE_SQL = f"""
    SELECT r.product_id, policy, r.episode, r.step,
           {rnd(clip('(r.price / r.base_price - 1e0) / 0.5e0', '-2e0', '2e0'))} AS price_ratio,
           {rnd(f'r.inventory / {P.max_inventory}e0 * 2e0 - 1e0')} AS inventory_ratio,
           {rnd(f'sin({TWO_PI} * (isodow(next_date) - 1) / 7)')} AS dow_sin, {rnd(f'cos({TWO_PI} * (isodow(next_date) - 1) / 7)')} AS dow_cos,
           {rnd(f'sin({TWO_PI} * dayofyear(next_date) / 365)')} AS season_signal, {rnd('trend')} AS demand_trend,
           {rnd(clip('''(r.price - coalesce(lag(r.price, 2) OVER (PARTITION BY r.product_id, policy, r.episode
                         ORDER BY r.step), r.base_price)) / (r.base_price + 1e-8)''', '-1e0', '1e0'))} AS price_momentum,
           {rnd(clip('r.elasticity / 3e0', '-2e0', '2e0'))} AS elasticity_signal,
           {rnd(f'1e0 - r.inventory / {P.max_inventory}e0')} AS stockout_risk,
           CASE category WHEN 'Subscription Box' THEN -0.5e0 WHEN 'Home & Garden Service' THEN 0e0
                         WHEN 'Digital' THEN 0.5e0 WHEN 'Perishable' THEN 1e0 ELSE -1e0 END AS category_signal
    FROM run r JOIN described d ON d.product_id = r.product_id"""


@query("R5", FEATURE_SQL)
def ten_feature_table(spark, sf_dir):
    return B.rounded(features.observations(steps_of(spark, sf_dir), B.catalogue(spark, sf_dir), P))


@query("R5", FEATURE_SQL)
def ten_feature_table_of_log(spark, sf_dir):
    """The same features without a join or window: logged episodes carry histories and figures."""
    return B.rounded(features.observations_of_log(steps_of(spark, sf_dir), P))


def _cautious_levels(vectors: pd.Series) -> pd.Series:
    """A stand-in for a trained model: up with the trend, down with the stock-out risk."""
    x = np.stack(vectors.to_numpy())
    trend, risk = x[:, features.FEATURES.index("demand_trend")], x[:, features.FEATURES.index("stockout_risk")]
    return pd.Series(np.floor(np.clip(5.0 + 4.0 * trend - 3.0 * risk, 0.0, 10.0)).astype("int32"))


@query(
    "P1",
    f"""SELECT product_id, policy, episode, step, CAST(floor(greatest(0e0, least(10e0,
        5e0 + 4e0 * trend - 3e0 * (1e0 - inventory / {P.max_inventory}e0)))) AS INTEGER) AS action FROM run""",
)
def external_model_levels(spark, sf_dir):
    rows = features.observations_of_log(steps_of(spark, sf_dir), P)
    choose = policies.model_policy(_cautious_levels)
    vectors = features.feature_vector(rows)
    return vectors.select(*E.EPISODE_KEYS, "step", choose("features").alias("action"))


@query(
    "W7",
    f"""SELECT product_id, policy, episode, step, {rnd('''sum(revenue) OVER (PARTITION BY product_id, policy, episode
        ORDER BY step ROWS UNBOUNDED PRECEDING)''', 3)} AS running_revenue FROM run""",
)
def running_episode_revenue(spark, sf_dir):
    rows = running_revenue(steps_of(spark, sf_dir), E.EPISODE_KEYS, "step")
    return B.rounded(rows.select(*E.EPISODE_KEYS, "step", "running_revenue"), 3)


# --- evaluation -------------------------------------------------------------------------


@query(
    "A7",
    f"""SELECT product_id, policy, episode, {rnd('total_reward')} AS total_reward, {rnd('total_revenue', 3)} AS total_revenue,
        {rnd('price_sum', 4)} AS price_sum, n_steps FROM totals""",
)
def episode_totals(spark, sf_dir):
    return B.rounded(E.episode_totals(steps_of(spark, sf_dir)), total_revenue=3, price_sum=4)


EVALUATION = f"""policy, product_id, {rnd('mean_reward')} AS mean_reward, {rnd('std_reward')} AS std_reward,
    {rnd('mean_revenue', 3)} AS mean_revenue, {rnd('avg_price', 4)} AS avg_price, n_episodes"""


@query("A8", f"SELECT {EVALUATION} FROM evaluation")
def policy_evaluation(spark, sf_dir):
    return B.rounded(E.evaluate_policies(totals_of(spark, sf_dir)), mean_revenue=3, avg_price=4)


@query(
    "A10",
    f"""SELECT policy, {rnd('avg(mean_reward)')} AS mean_reward, {rnd('avg(std_reward)')} AS std_reward
        FROM evaluation GROUP BY policy""",
)
def policy_summary(spark, sf_dir):
    totals = totals_of(spark, sf_dir)
    return B.rounded(E.summarise_policies(E.evaluate_policies(totals)))


@query(
    "A11",
    f"""SELECT episode AS iteration, {rnd('avg(total_reward)')} AS mean_reward, {rnd('min(total_reward)')} AS min_reward,
        {rnd('max(total_reward)')} AS max_reward FROM totals GROUP BY episode""",
)
def task_batch_statistics(spark, sf_dir):
    totals = totals_of(spark, sf_dir)
    return B.rounded(E.task_batch_stats(totals.withColumnRenamed("episode", "iteration")))


@query(
    "A12",
    f"""SELECT product_id, policy, episode, {rnd('total_reward')} AS reward, {rnd('total_revenue', 3)} AS revenue FROM totals""",
)
def learning_log(spark, sf_dir):
    totals = totals_of(spark, sf_dir)
    return B.rounded(E.learning_log(totals), revenue=3)


@query(
    "R11",
    f"""SELECT product_id, policy, {rnd('mean_reward', 3)} AS mean, {rnd('std_reward', 3)} AS std, n_episodes AS n_eval
        FROM evaluation WHERE product_id = '7'""",
)
def benchmark_of_one_product(spark, sf_dir):
    totals = E.episode_totals(episodes_.steps_of_days(C.find_product(B.priced(spark, sf_dir), 7), P))
    return E.benchmark_report(E.evaluate_policies(totals))


@query(
    "R12, T4",
    f"""SELECT policy, {rnd('mean_reward')} AS mean_reward, {rnd('std_reward')} AS std_reward,
        CAST(row_number() OVER (ORDER BY mean_reward DESC, policy) AS INTEGER) AS rank
        FROM (SELECT policy, avg(mean_reward) AS mean_reward, avg(std_reward) AS std_reward
              FROM evaluation GROUP BY policy)""",
)
def policy_leaderboard(spark, sf_dir):
    return B.rounded(E.full_benchmark(steps_of(spark, sf_dir)))


def _weight(product: str, episode: str, replicate: str) -> str:
    drawn = unit(product, episode, replicate, 17)
    return "(" + " + ".join(f"CASE WHEN {drawn} >= {limit!r}::DOUBLE THEN 1 ELSE 0 END" for limit in I.POISSON) + ")"


cte(
    "replicated",
    f"""
    SELECT policy, product_id, replicate, sum(w * total_reward) / sum(w) AS mean
    FROM (SELECT t.*, r AS replicate, {_weight('product_id', 'episode', 'r')} AS w FROM totals t, range({I.REPLICATES}) x(r))
    WHERE w > 0 GROUP BY policy, product_id, replicate""",
)
_LOW = "list_sort(list(mean))[CAST(floor(count(*) * 0.05e0) AS INTEGER) + 1]"
_HIGH = "list_sort(list(mean))[CAST(count(*) - floor(count(*) * 0.05e0) AS INTEGER)]"


@query(
    "A8",
    f"""SELECT policy, product_id, {rnd(_LOW)} AS low, {rnd(_HIGH)} AS high, count(*) AS n_replicates
        FROM replicated GROUP BY policy, product_id""",
)
def policy_evaluation_intervals(spark, sf_dir):
    """Nine times in ten the mean reward of a policy on a product lies between these bounds, as its episodes vary."""
    return B.rounded(I.product_intervals(I.replicated_means(totals_of(spark, sf_dir))))


@query(
    "A10, T4, R12",
    f"""SELECT policy, {rnd(_LOW)} AS low, {rnd(_HIGH)} AS high, {rnd('avg(CASE WHEN place = 1 THEN 1e0 ELSE 0e0 END)')} AS first_share,
        {rnd('avg(place)')} AS mean_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY mean DESC, policy) AS place
              FROM (SELECT policy, replicate, avg(mean) AS mean FROM replicated GROUP BY policy, replicate))
        GROUP BY policy""",
)
def policy_leaderboard_intervals(spark, sf_dir):
    """How sure the leaderboard is: bounds of each policy's mean, and how often it comes first."""
    return B.rounded(I.policy_intervals(I.replicated_means(totals_of(spark, sf_dir))))


@query("U2", f"SELECT {EVALUATION} FROM evaluation")
def united_policy_results(spark, sf_dir):
    evaluation = E.evaluate_policies(totals_of(spark, sf_dir))
    parts = [evaluation.filter(F.col("policy") == name) for name in ("below_list", "at_list", "above_list")]
    return B.rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), mean_revenue=3, avg_price=4)
