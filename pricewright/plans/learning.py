"""Registered queries: learning data and tabular learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import product_number
from ..functions.pricing import geometric_epsilon
from ..operators import evaluate as E
from ..operators import learning as L
from ..operators import episodes as episodes_
from ..operators.windows import newest_rows
from ..session import write_once
from . import base as B
from .policies import steps_of
from .registry import cte, query
from .sql import clip, code_order, mixed_hash, rnd, unit

P = B.TIGHT


def _bucket(trend: str, stock: str) -> str:
    return (
        f"CAST((CASE WHEN {trend} > 0.1e0 THEN 2 WHEN {trend} < -0.1e0 THEN 0 ELSE 1 END) * 4 "
        f"+ least(3, CAST(trunc({stock} * 4 / {P.max_inventory}e0) AS INTEGER)) AS INTEGER)"
    )


cte(
    "moves",
    f"""
    SELECT product_id, policy, episode, step, {_bucket('trend_before', 'inventory_before')} AS state, action, reward,
           {_bucket('trend', 'inventory')} AS next_state,
           step = 29 OR start + step = n_rows - 1 AS done, start, n_rows
    FROM run""",
)


def _target(value: str) -> str:
    return clip(f"reward + 0.99e0 * {value} * (CASE WHEN done THEN 0e0 ELSE 1e0 END)", "-50e0", "50e0")


cte("q1", f"SELECT product_id, state, action, avg({_target('0e0')}) AS q FROM moves GROUP BY product_id, state, action")
cte("v1", "SELECT product_id, state AS next_state, max(q) AS next_value FROM q1 GROUP BY product_id, state")
cte(
    "q2",
    f"""
    SELECT product_id, state, action, coalesce(n.q, q1.q) AS q FROM q1 FULL JOIN (
        SELECT m.product_id, m.state, m.action, avg({_target('coalesce(next_value, 0e0)')}) AS q
        FROM moves m LEFT JOIN v1 ON v1.product_id = m.product_id AND v1.next_state = m.next_state
        GROUP BY m.product_id, m.state, m.action) n USING (product_id, state, action)""",
)


def pooled_sql(q: str) -> str:
    """Mean of all other products, cell by cell."""
    return f"""
    SELECT g.product_id, g.state, g.action,
           (total - coalesce(own.q, 0e0)) / (n - CASE WHEN own.q IS NULL THEN 0 ELSE 1 END) AS q
    FROM (SELECT * FROM (SELECT DISTINCT product_id FROM {q}),
          (SELECT state, action, sum(q) AS total, count(*) AS n FROM {q} GROUP BY state, action)) g
    LEFT JOIN {q} own USING (product_id, state, action)
    WHERE n - CASE WHEN own.q IS NULL THEN 0 ELSE 1 END > 0"""


cte("prior", pooled_sql("q1"))


def _adapt(number: int, before: str) -> None:
    """One sweep over the first episodes, from the table ``before``."""
    cte(
        f"w{number}",
        f"SELECT product_id, state AS next_state, max(q) AS next_value FROM {before} GROUP BY product_id, state",
    )
    cte(
        f"adapted{number}",
        f"""
        SELECT product_id, state, action, coalesce(n.q, b.q) AS q FROM {before} b FULL JOIN (
            SELECT m.product_id, m.state, m.action, avg({_target('coalesce(next_value, 0e0)')}) AS q
            FROM moves m LEFT JOIN w{number} w ON w.product_id = m.product_id AND w.next_state = m.next_state
            WHERE m.episode < 3 GROUP BY m.product_id, m.state, m.action) n USING (product_id, state, action)""",
    )


_adapt(1, "prior")
_adapt(2, "adapted1")


def _moves(spark, sf_dir):
    return L.transitions(steps_of(spark, sf_dir), P)


def _stored_moves(spark, sf_dir):
    """Written once, for queries that read the transitions more than once."""
    return write_once(_moves(spark, sf_dir), "transitions")


@query(
    "L1",
    f"SELECT product_id, policy, episode, step, state, action, {rnd('reward')} AS reward, next_state, done FROM moves",
)
def transition_table(spark, sf_dir):
    return B.rounded(_moves(spark, sf_dir))


@query(
    "L1",
    f"""SELECT product_id, policy, episode, step, state, action, {rnd('reward')} AS reward,
        lead(state) OVER (PARTITION BY product_id, policy, episode ORDER BY step) AS next_state, done FROM moves""",
)
def transition_table_from_log(spark, sf_dir):
    log = _moves(spark, sf_dir).drop("next_state", "done")
    return B.rounded(L.transitions_from_log(log, L.EPISODE_KEYS, "step"))


@query(
    "W9",
    f"""SELECT product_id, episode, step, state, action, {rnd('reward')} AS reward, episode * 30 + step AS seq FROM moves
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY episode * 30 + step DESC) <= 100""",
)
def newest_transitions(spark, sf_dir):
    seq = F.col("episode") * P.episode_len + F.col("step")
    rows = _stored_moves(spark, sf_dir).select(
        "product_id", "episode", "step", "state", "action", "reward", seq.alias("seq")
    )
    return B.rounded(newest_rows(rows, ["product_id"], "seq", capacity=100))


@query(
    "L2",
    f"""SELECT product_id, episode, step, state, action, {rnd('reward')} AS reward, next_state, done
        FROM moves WHERE (SELECT count(*) FROM moves) >= 128
        ORDER BY {mixed_hash('product_id', 'episode', 'step', 1)}, CAST(product_id AS BIGINT), episode, step LIMIT 128""",
)
def training_minibatch(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    number = product_number(F.col("product_id"))
    return B.rounded(L.minibatch(rows, number, F.col("episode"), F.col("step"), 128, seed=1).drop("policy"))


@query(
    "L2",
    f"""SELECT product_id, episode, step, state, action, {rnd('reward')} AS reward, next_state, done FROM moves
        QUALIFY row_number() OVER (PARTITION BY product_id
            ORDER BY {mixed_hash('product_id', 'episode', 'step', 1)}, episode, step) <= 64""",
)
def product_minibatches(spark, sf_dir):
    """A batch of 64 transitions of every product, fed in two parts: the kept sample of the first with the rows of the second."""
    rows = _stored_moves(spark, sf_dir).drop("policy")
    number = product_number(F.col("product_id"))
    sample = [number, F.col("episode"), F.col("step"), 64, 1]
    kept = L.kept_samples(rows.filter("episode % 2 = 0"), ["product_id"], *sample)
    return B.rounded(L.kept_samples(kept.unionByName(rows.filter("episode % 2 = 1")), ["product_id"], *sample))


@query(
    "L3",
    f"""SELECT CAST(i AS INTEGER) AS iteration, CAST(s AS INTEGER) AS slot, p.product_id
        FROM range(50) a(i), range(8) b(s)
        JOIN (SELECT product_id, row_number() OVER (ORDER BY {code_order('product_id')}) AS position FROM described) p
        ON p.position = {mixed_hash('0', 'i', 's', 3)} % (SELECT count(*) FROM described) + 1""",
)
def task_batches(spark, sf_dir):
    return L.task_batches(B.catalogue(spark, sf_dir), 50, 8, seed=3)


@query(
    "L4, X21",
    f"""SELECT product_id, {rnd('avg(CASE WHEN abs(gap) < 1 THEN 0.5e0 * gap * gap ELSE abs(gap) - 0.5e0 END)')} AS mean_loss,
        {rnd('avg(target)')} AS mean_target, count(*) AS n_transitions
        FROM (SELECT *, coalesce(q1.q, 0e0) - target AS gap
              FROM (SELECT m.*, {_target('coalesce(next_value, 0e0)')} AS target
                    FROM moves m LEFT JOIN v1 ON v1.product_id = m.product_id AND v1.next_state = m.next_state) t
              LEFT JOIN q1 USING (product_id, state, action)) GROUP BY product_id""",
)
def td_targets_and_loss(spark, sf_dir):
    moves = _stored_moves(spark, sf_dir)
    targets = L.td_targets(moves, L.sweep(moves, None, ["product_id"]), ["product_id"])
    out = targets.groupBy("product_id").agg(
        F.avg("loss").alias("mean_loss"), F.avg("target").alias("mean_target"), F.count("*").alias("n_transitions")
    )
    return B.rounded(out)


@query(
    "L5",
    f"""SELECT product_id, state, action, {rnd('q')} AS q FROM q1
        QUALIFY row_number() OVER (PARTITION BY product_id, state ORDER BY q DESC, action) = 1""",
)
def greedy_actions(spark, sf_dir):
    q = L.sweep(_moves(spark, sf_dir), None, ["product_id"])
    return B.rounded(L.greedy_actions(q, ["product_id"]))


@query(
    "L5, X20",
    f"""SELECT m.product_id, m.episode, m.step,
        CAST(CASE WHEN {unit('m.product_id', 'm.episode', 'm.step', 11)} < greatest(0.05e0, 1e0 * pow(0.5e0, m.episode))
             THEN {mixed_hash('m.product_id', 'm.episode', 'm.step', 12)} % 11 ELSE g.action END AS INTEGER) AS action
        FROM moves m JOIN (SELECT * FROM q1 QUALIFY row_number() OVER
             (PARTITION BY product_id, state ORDER BY q DESC, action) = 1) g
        ON g.product_id = m.product_id AND g.state = m.state""",
)
def epsilon_greedy_actions(spark, sf_dir):
    # Values, best actions and the join share this dealing, so no task gets more rows as the input grows.
    moves = _stored_moves(spark, sf_dir).repartition(B.tasks(spark, sf_dir), "product_id", "state")
    best = L.greedy_actions(L.sweep(moves, None, ["product_id"]), ["product_id"])
    rows = moves.drop("action").join(best.select("product_id", "state", "action"), ["product_id", "state"])
    epsilon = geometric_epsilon(F.col("episode"), decay=0.5)
    chosen = L.epsilon_greedy(
        F.col("action"), epsilon, F.col("product_id"), F.col("episode"), F.col("step"), P.price_levels, seed=11
    )
    return rows.select("product_id", "episode", "step", chosen.alias("action"))


@query("L6", f"SELECT product_id, state, action, {rnd('q')} AS q FROM q2")
def fitted_q_per_product(spark, sf_dir):
    return B.rounded(L.fitted_q(_moves(spark, sf_dir), ["product_id"], sweeps=2))


for _n in (3, 4):
    cte(f"v{_n - 1}", f"SELECT product_id, state AS next_state, max(q) AS next_value FROM q{_n - 1} GROUP BY product_id, state")
    cte(
        f"q{_n}",
        f"""
        SELECT m.product_id, m.state, m.action, avg({_target('coalesce(next_value, 0e0)')}) AS q
        FROM moves m LEFT JOIN v{_n - 1} v ON v.product_id = m.product_id AND v.next_state = m.next_state
        GROUP BY m.product_id, m.state, m.action""",
    )


@query("L6", f"SELECT product_id, state, action, {rnd('q')} AS q FROM q4")
def swept_q_per_product(spark, sf_dir):
    """Four sweeps that read only the transitions of cells whose targets can have moved."""
    return B.rounded(L.converged_q(_moves(spark, sf_dir), ["product_id"], tolerance=0.0, most=4)[0])


@query("L7", f"SELECT product_id, state, action, {rnd('q')} AS q FROM prior")
def prior_of_other_products(spark, sf_dir):
    return B.rounded(L.pooled_prior(L.fitted_q(_moves(spark, sf_dir), ["product_id"], sweeps=1)))


@query("L7", f"SELECT product_id, state, action, {rnd('q')} AS q FROM adapted2")
def adapted_q_per_product(spark, sf_dir):
    moves = _stored_moves(spark, sf_dir)
    prior = L.pooled_prior(L.fitted_q(moves, ["product_id"], sweeps=1))
    return B.rounded(L.adapted_q(moves, prior, n_episodes=3, sweeps=2))


cte(
    "best",
    """SELECT product_id, state, action FROM q2
       QUALIFY row_number() OVER (PARTITION BY product_id, state ORDER BY q DESC, action) = 1""",
)
# Learning and evaluation by halves of each product's days, so no day is in both.
cte("early_moves", "SELECT * FROM moves WHERE 2 * (start + step + 1) <= n_rows")
cte("late_moves", "SELECT * FROM moves WHERE 2 * (start + step + 1) > n_rows")
cte(
    "early_q1",
    f"SELECT product_id, state, action, avg({_target('0e0')}) AS q FROM early_moves GROUP BY product_id, state, action",
)
cte(
    "early_q2",
    f"""
    SELECT product_id, state, action, coalesce(n.q, b.q) AS q FROM early_q1 b FULL JOIN (
        SELECT m.product_id, m.state, m.action, avg({_target('coalesce(next_value, 0e0)')}) AS q
        FROM early_moves m LEFT JOIN (SELECT product_id, state AS next_state, max(q) AS next_value
                                      FROM early_q1 GROUP BY product_id, state) w
             ON w.product_id = m.product_id AND w.next_state = m.next_state
        GROUP BY m.product_id, m.state, m.action) n USING (product_id, state, action)""",
)


def _halves(spark, sf_dir):
    steps = write_once(steps_of(spark, sf_dir), "steps")
    return [write_once(L.transitions(part, P), "transitions") for part in (episodes_.earlier(steps), episodes_.later(steps))]


MATCHED = f"""count(*) AS n_steps, count(*) FILTER (WHERE m.action = coalesce(b.action, 5)) AS n_matched,
        {rnd('avg(reward) FILTER (WHERE m.action = coalesce(b.action, 5))')} AS matched_reward, {rnd('avg(reward)')} AS logged_reward"""


@query(
    "A9",
    f"""SELECT m.product_id, {MATCHED}
        FROM late_moves m LEFT JOIN (SELECT product_id, state, action FROM early_q2
             QUALIFY row_number() OVER (PARTITION BY product_id, state ORDER BY q DESC, action) = 1) b
        ON b.product_id = m.product_id AND b.state = m.state GROUP BY m.product_id""",
)
def learned_policy_evaluation(spark, sf_dir):
    """Learned from the earlier episodes, judged on the later ones by the steps that agree with it."""
    early, late = _halves(spark, sf_dir)
    best = L.greedy_actions(L.fitted_q(early, ["product_id"], sweeps=2), ["product_id"])
    return B.rounded(E.matched_evaluation(late, best, ["product_id"]))


@query(
    "A9, R11",
    f"""WITH cells AS (
          SELECT product_id, state, action, count(*) AS n, sum(reward) AS rewards, sum(count(*)) OVER (PARTITION BY product_id, state) AS in_state
          FROM late_moves GROUP BY product_id, state, action),
        chosen AS (SELECT product_id, state, action AS learned FROM early_q2
                   QUALIFY row_number() OVER (PARTITION BY product_id, state ORDER BY q DESC, action) = 1),
        usual AS (SELECT product_id, avg(q) AS usual_q FROM early_q1 GROUP BY product_id),
        joined AS (
          SELECT c.*, coalesce(b.learned, 5) AS learned, coalesce(o.q, usual_q) AS own_q, coalesce(l.q, usual_q) AS learned_q,
                 CASE WHEN c.action = coalesce(b.learned, 5) THEN in_state / c.n::DOUBLE END AS w
          FROM cells c LEFT JOIN chosen b ON b.product_id = c.product_id AND b.state = c.state
          LEFT JOIN early_q1 o ON o.product_id = c.product_id AND o.state = c.state AND o.action = c.action
          LEFT JOIN early_q1 l ON l.product_id = c.product_id AND l.state = c.state AND l.action = coalesce(b.learned, 5)
          LEFT JOIN usual u ON u.product_id = c.product_id),
        figures AS (
          SELECT product_id, sum(n)::BIGINT AS n_steps, coalesce(sum(n) FILTER (w IS NOT NULL), 0)::BIGINT AS n_agreeing,
                 sum(rewards) / sum(n) AS logged_reward, sum(w * rewards) / sum(w * n) AS weighted_reward,
                 sum(n * learned_q) / sum(n) AS model_reward,
                 sum(n * learned_q) / sum(n) + sum(w * (rewards - n * own_q)) / sum(w * n) AS corrected_reward,
                 sum(w * n) * sum(w * n) / sum(w * w * n) AS effective_steps
          FROM joined GROUP BY product_id)
        SELECT product_id, n_steps, n_agreeing, {rnd('logged_reward')} AS logged_reward, {rnd('weighted_reward')} AS weighted_reward,
               {rnd('model_reward')} AS model_reward, {rnd('corrected_reward')} AS corrected_reward, {rnd('effective_steps')} AS effective_steps,
               CASE WHEN model_reward IS NULL THEN 'no_model' WHEN n_agreeing = 0 THEN 'no_agreement' ELSE 'none' END AS reason
        FROM figures""",
)
def off_policy_value(spark, sf_dir):
    """What the policy learned from the first half of the days would earn in the second, corrected for how prices were chosen there."""
    early, late = _halves(spark, sf_dir)
    model = write_once(L.sweep(early, None, ["product_id"]), "reward-model")
    best = L.greedy_actions(L.fitted_q(early, ["product_id"], sweeps=2), ["product_id"])
    return B.rounded(E.off_policy_evaluation(late, best, model, ["product_id"]))


# Adaptation curve: every number of episodes is one more key of the same sweeps.
TRIALS = [1, 3, 5]
cte(
    "trial_moves",
    f"""SELECT m.*, n AS n_episodes FROM early_moves m, (VALUES {', '.join(f'({n})' for n in TRIALS)}) t(n)
        WHERE m.episode < n""",
)
cte("prior_q2", pooled_sql("early_q2"))
cte("adapted_t0", f"SELECT p.*, n AS n_episodes FROM prior_q2 p, (VALUES {', '.join(f'({n})' for n in TRIALS)}) t(n)")
cte(
    "scratch_t1",
    f"""SELECT product_id, n_episodes, state, action, avg({_target('0e0')}) AS q FROM trial_moves
        GROUP BY product_id, n_episodes, state, action""",
)
for _before, _after in (("adapted_t0", "adapted_t1"), ("adapted_t1", "adapted_t2"), ("scratch_t1", "scratch_t2")):
    cte(
        _after,
        f"""
        SELECT product_id, n_episodes, state, action, coalesce(n.q, b.q) AS q FROM {_before} b FULL JOIN (
            SELECT m.product_id, m.n_episodes, m.state, m.action, avg({_target('coalesce(next_value, 0e0)')}) AS q
            FROM trial_moves m LEFT JOIN (SELECT product_id, n_episodes, state AS next_state, max(q) AS next_value
                                          FROM {_before} GROUP BY product_id, n_episodes, state) w
                 ON w.product_id = m.product_id AND w.n_episodes = m.n_episodes AND w.next_state = m.next_state
            GROUP BY m.product_id, m.n_episodes, m.state, m.action) n
        USING (product_id, n_episodes, state, action)""",
    )
cte(
    "trial_best",
    """
    SELECT product_id, learner, n_episodes, state, action FROM (
        SELECT *, 'adapted' AS learner FROM adapted_t2 UNION ALL SELECT *, 'scratch' FROM scratch_t2)
    QUALIFY row_number() OVER (PARTITION BY product_id, learner, n_episodes, state ORDER BY q DESC, action) = 1""",
)


@query(
    "L8, A9",
    f"""SELECT m.product_id, m.learner, m.n_episodes, {MATCHED}
        FROM (SELECT late_moves.*, l AS learner, n AS n_episodes FROM late_moves, (VALUES ('adapted'), ('scratch')) a(l),
                   (VALUES {', '.join(f'({n})' for n in TRIALS)}) t(n)) m
        LEFT JOIN trial_best b ON b.product_id = m.product_id AND b.learner = m.learner
             AND b.n_episodes = m.n_episodes AND b.state = m.state
        GROUP BY m.product_id, m.learner, m.n_episodes""",
)
def adaptation_curve(spark, sf_dir):
    """Agreement with and reward of what is learned from the first 1, 3 and 5 episodes, from the prior and from scratch."""
    early, late = _halves(spark, sf_dir)
    prior = L.pooled_prior(L.fitted_q(early, ["product_id"], sweeps=2))
    best = L.adaptation_actions(early, prior, TRIALS)
    trials = [F.struct(F.lit(k).alias("learner"), F.lit(n).alias("n_episodes")) for k in ("adapted", "scratch") for n in TRIALS]
    judged = late.select("*", F.inline(F.array(*trials)))
    return B.rounded(E.matched_evaluation(judged, best, ["product_id", "learner", "n_episodes"]))
