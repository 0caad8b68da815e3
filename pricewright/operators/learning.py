"""Learning data and tabular policy learning.

States are small buckets: the sign of the demand trend (three values) times the
stock quartile (four values), so one product has at most 12 states and 12 x 11
cells.  Q tables are long DataFrames ``keys, state, action, q``.

The learners here are tabular stand-ins for what per-product training and
few-episode adaptation are for; they do not reproduce any neural network's numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import mixed_hash, mixed_unit, product_number
from ..functions.pricing import huber, td_target
from ..params import EpisodeParams, LearnParams
from ..session import reads_files, write_once
from .positions import code_order, with_position

EPISODE_KEYS = ["product_id", "policy", "episode"]
TREND_BUCKETS = 3


def state_bucket(trend: Column, inventory: Column, max_inventory: int, learn: LearnParams = LearnParams()) -> Column:
    """Bucket number from demand trend and stock."""
    sign = F.when(trend > learn.trend_threshold, 2).when(trend < -learn.trend_threshold, 0).otherwise(1)
    stock = F.least(
        F.lit(learn.stock_buckets - 1), (inventory * F.lit(learn.stock_buckets) / F.lit(max_inventory)).cast("int")
    )
    return (sign * F.lit(learn.stock_buckets) + stock).cast("int")


def n_states(learn: LearnParams = LearnParams()) -> int:
    return TREND_BUCKETS * learn.stock_buckets


def transitions(steps: DataFrame, params: EpisodeParams = EpisodeParams(), learn: LearnParams = LearnParams()) -> DataFrame:
    """State, action, reward, next state and end flag of each logged step; the last day of a calendar ends its episode."""
    ends = (F.col("step") == params.episode_len - 1) | (F.col("start") + F.col("step") == F.col("n_rows") - 1)
    return steps.select(
        *EPISODE_KEYS,
        "step",
        state_bucket(F.col("trend_before"), F.col("inventory_before"), params.max_inventory, learn).alias("state"),
        "action",
        "reward",
        state_bucket(F.col("trend"), F.col("inventory"), params.max_inventory, learn).alias("next_state"),
        ends.alias("done"),
    )


def transitions_from_log(log: DataFrame, keys: list[str], order: str, state: str = "state") -> DataFrame:
    """Transitions of an external log that has only the state before each step.

    The last step of an episode is its end; it has no next state.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    following = F.lead(state).over(ordered)
    last = F.row_number().over(ordered) == F.count("*").over(Window.partitionBy(*keys))
    return log.withColumn("next_state", following).withColumn("done", last)


def minibatch(rows: DataFrame, key_no: Column, first: Column, second: Column, size: int = 128, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement, or none while there are fewer than ``size``.

    The draw orders rows by a repeatable hash; a distributed top-n keeps ``size`` of
    them.  ``key_no, first, second`` identify a row and break ties.
    """
    order = F.struct(mixed_hash(key_no, first, second, seed), key_no, first, second)
    drawn = rows.withColumn("_drawn", order).orderBy("_drawn").limit(size)
    enough = F.count("*").over(Window.partitionBy(F.lit(1)))  # over at most ``size`` rows
    return drawn.withColumn("_n", enough).filter(F.col("_n") >= size).drop("_drawn", "_n")


def kept_samples(rows: DataFrame, keys: list[str], key_no: Column, first: Column, second: Column, size: int = 128, seed: int = 0) -> DataFrame:
    """Of each ``keys`` the ``size`` rows of the smallest repeatable hashes: a sample that merges.

    The sample of old rows united with new ones gives the sample of both, so rows may come batch by batch.  Every task
    keeps ``size`` rows a key before anything is shuffled, so a key with a third of all rows is no burden.
    """
    order = Window.partitionBy(*keys).orderBy(mixed_hash(key_no, first, second, seed), key_no, first, second)
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= size).drop("_place")


def task_batches(products: DataFrame, iterations: int, batch: int = 8, seed: int = 0) -> DataFrame:
    """``batch`` products with replacement for each iteration."""
    ranked = with_position(products.select("product_id"), code_order("product_id"))
    n_products = ranked.agg(F.count("*"))
    draws = (
        products.sparkSession.range(iterations)
        .select(F.col("id").cast("int").alias("iteration"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
        .withColumn("position", F.pmod(mixed_hash(F.lit(0), F.col("iteration"), F.col("slot"), seed), n_products.scalar()) + 1)
    )
    return draws.join(ranked, "position").select("iteration", "slot", "product_id")


# --- Q tables -------------------------------------------------------------------


def greedy_actions(q: DataFrame, keys: list[str]) -> DataFrame:
    """Best action per state; the lowest action wins a tie."""
    best = F.max(F.struct(F.col("q"), (-F.col("action")).alias("neg"))).alias("_best")
    return q.groupBy(*keys, "state").agg(best).select(
        *keys, "state", (-F.col("_best.neg")).alias("action"), F.col("_best.q").alias("q")
    )


def greedy_of_array(values: Column) -> Column:
    """Best action of a dense Q row; the lowest action wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def epsilon_greedy(greedy: Column, epsilon: Column, product_id: Column, episode: Column, step: Column, levels: int = 11, seed: int = 0) -> Column:
    """Random level with probability ``epsilon``, else the greedy one; draws are repeatable."""
    number = product_number(product_id)
    explored = F.pmod(mixed_hash(number, episode, step, seed + 1), F.lit(levels)).cast("int")
    return F.when(mixed_unit(number, episode, step, seed) < epsilon, explored).otherwise(greedy)


def td_targets(rows: DataFrame, q: DataFrame, keys: list[str], learn: LearnParams = LearnParams()) -> DataFrame:
    """Transitions with current value, next value, clamped target and Huber loss.

    Unknown cells count as 0.
    """
    values = q.groupBy(*keys, F.col("state").alias("next_state")).agg(F.max("q").alias("next_value"))
    current = q.select(*keys, "state", "action", F.col("q").alias("current_q"))
    joined = rows.join(values, [*keys, "next_state"], "left").join(current, [*keys, "state", "action"], "left")
    zero = F.lit(0.0)
    target = td_target(F.col("reward"), F.coalesce("next_value", zero), F.col("done"), learn.gamma, learn.target_clamp)
    return (
        joined.withColumn("current_q", F.coalesce("current_q", zero))
        .withColumn("target", target)
        .withColumn("loss", huber(F.col("current_q") - F.col("target")))
        .drop("next_value")
    )


def mean_loss(targets: DataFrame, keys: list[str]) -> DataFrame:
    return targets.groupBy(*keys).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n_transitions"))


def sweep(rows: DataFrame, q: DataFrame | None, keys: list[str], learn: LearnParams = LearnParams()) -> DataFrame:
    """One fitted-Q sweep against a frozen ``q`` (none means all zero).

    A cell becomes the mean target of its transitions; cells of ``q`` without
    transitions keep their value.  Targets are averaged map-side first, so a product
    with a third of all transitions sends at most one row per cell and task.
    """
    if q is None:
        valued = rows.withColumn("next_value", F.lit(0.0))
    else:
        values = q.groupBy(*keys, F.col("state").alias("next_state")).agg(F.max("q").alias("next_value"))
        valued = rows.join(values, [*keys, "next_state"], "left")
    target = td_target(
        F.col("reward"), F.coalesce("next_value", F.lit(0.0)), F.col("done"), learn.gamma, learn.target_clamp
    )
    fresh = valued.groupBy(*keys, "state", "action").agg(F.avg(target).alias("q"))
    if q is None:
        return fresh
    cell = [*keys, "state", "action"]
    return (
        q.select(*cell, F.col("q").alias("_old"))
        .join(fresh, cell, "full")
        .select(*cell, F.coalesce("q", "_old").alias("q"))
    )


def fitted_q(
    rows: DataFrame, keys: list[str], sweeps: int = 2, learn: LearnParams = LearnParams(), prior: DataFrame | None = None
) -> DataFrame:
    """Tabular fitted-Q: each sweep uses the previous sweep's table as frozen target.

    The transitions are written once, because every sweep reads them, unless they are read
    from files already; a table is written after each sweep, so the plan of sweep k does not hold k of them.
    """
    columns = [*keys, "state", "action", "reward", "next_state", "done"]
    stored = rows.select(*columns)
    if sweeps > 1 and not reads_files(stored):
        stored = write_once(stored, "transitions")
    q = prior
    for i in range(sweeps):
        q = sweep(stored, q, keys, learn)
        if i < sweeps - 1:
            q = write_once(q, "q-table")
    return q


def converged_q(
    rows: DataFrame, keys: list[str], learn: LearnParams = LearnParams(), tolerance: float = 1e-6, most: int = 1000
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Sweeps until no cell moves by more than ``tolerance``, and for each the number of transitions it read and the largest move.

    A cell's target changes only if the value of a state its transitions lead to has changed.  A table of
    predecessors, cells by the states they lead to, names the cells to sweep again, so transitions of settled cells
    are not read.  With ``tolerance`` 0 the result after n sweeps is that of n sweeps over everything.  The driver
    sees two numbers a sweep.
    """
    cell = [*keys, "state", "action"]
    stored = rows.select(*cell, "reward", "next_state", "done")
    if not reads_files(stored):
        stored = write_once(stored, "transitions")
    leads = write_once(stored.filter(~F.col("done")).select(*cell, "next_state").distinct(), "predecessors")
    q = write_once(sweep(stored, None, keys, learn), "q-table")
    log = [(stored.count(), q.agg(F.max(F.abs("q"))).first()[0] or 0.0)]
    values = q.groupBy(*keys, "state").agg(F.max("q").alias("value"))
    moved = values.filter(F.abs("value") > tolerance).select(*keys, F.col("state").alias("next_state"))
    while len(log) < most:
        open_cells = write_once(leads.join(moved, [*keys, "next_state"], "left_semi").select(cell).distinct(), "open-cells")
        some = stored.join(open_cells, cell, "left_semi")
        fresh = write_once(_swept(some, q, keys, learn), "swept")
        joined = write_once(
            q.withColumnRenamed("q", "_old").join(fresh, cell, "left").select(*cell, "_old", F.coalesce("q", "_old").alias("q"), "_n"), "q-moves"
        )
        n, move = joined.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max(F.abs(F.col("q") - F.col("_old"))), F.lit(0.0))).first()
        if not n:
            break
        log.append((n, move))
        change = joined.groupBy(*keys, "state").agg(F.max("_old").alias("before"), F.max("q").alias("after"))
        moved = change.filter(F.abs(F.col("after") - F.col("before")) > tolerance).select(*keys, F.col("state").alias("next_state"))
        q = joined.select(*cell, "q")
        if move <= tolerance:
            break
    return q, log


def _swept(rows: DataFrame, q: DataFrame, keys: list[str], learn: LearnParams) -> DataFrame:
    """Mean target of each cell of ``rows`` against ``q``, and how many transitions it has."""
    values = q.groupBy(*keys, F.col("state").alias("next_state")).agg(F.max("q").alias("next_value"))
    valued = rows.join(values, [*keys, "next_state"], "left")
    target = td_target(F.col("reward"), F.coalesce("next_value", F.lit(0.0)), F.col("done"), learn.gamma, learn.target_clamp)
    return valued.groupBy(*keys, "state", "action").agg(F.avg(target).alias("q"), F.count("*").alias("_n"))


def pooled_prior(q: DataFrame, key: str = "product_id") -> DataFrame:
    """For each product the mean Q of all other products, cell by cell.

    Leave-one-out is total minus own.  The totals have one row per (state, action),
    at most 132, whatever the number of products, so they are sent to every task.
    """
    cell = ["state", "action"]
    totals = q.groupBy(*cell).agg(F.sum("q").alias("_sum"), F.count("*").alias("_n"))
    products = q.select(key).distinct()
    own = q.select(key, *cell, F.col("q").alias("_own"))
    # Every product gets every known cell: an explode of the (bounded) totals, no join.
    known = totals.agg(F.collect_list(F.struct(*cell, "_sum", "_n")).alias("_cells")).scalar()
    grid = products.withColumn("_cells", known).select(key, F.inline("_cells"))
    left_out = grid.join(own, [key, *cell], "left")
    others = F.col("_n") - F.when(F.col("_own").isNull(), 0).otherwise(1)
    total = F.col("_sum") - F.coalesce("_own", F.lit(0.0))
    return left_out.filter(others > 0).select(key, *cell, (total / others).alias("q"))


def adapted_q(
    rows: DataFrame,
    prior: DataFrame,
    n_episodes: int = 10,
    sweeps: int = 2,
    learn: LearnParams = LearnParams(),
) -> DataFrame:
    """Start from the prior and learn from a product's first ``n_episodes`` episodes only."""
    few = rows.filter(F.col("episode") < n_episodes)
    return fitted_q(few, ["product_id"], sweeps, learn, prior)


def by_episode_count(rows: DataFrame, counts: list[int]) -> DataFrame:
    """Copy each transition into every experiment that may use its episode."""
    used = F.array(*[F.lit(n) for n in counts])
    return rows.withColumn("n_episodes", F.explode(F.filter(used, lambda n: n > F.col("episode"))))


def adaptation_actions(
    rows: DataFrame,
    prior: DataFrame,
    counts: list[int],
    sweeps: int = 2,
    learn: LearnParams = LearnParams(),
) -> DataFrame:
    """Best actions learned from each number of episodes, from the prior and from scratch.

    All counts learn in one pass: the count is one more key of the sweep.
    """
    keys = ["product_id", "n_episodes"]
    experiments = by_episode_count(rows, counts)
    start = prior.withColumn("n_episodes", F.explode(F.array(*[F.lit(n) for n in counts])))
    adapted = greedy_actions(fitted_q(experiments, keys, sweeps, learn, start), keys)
    scratch = greedy_actions(fitted_q(experiments, keys, sweeps, learn), keys)
    return adapted.withColumn("learner", F.lit("adapted")).unionByName(scratch.withColumn("learner", F.lit("scratch")))
