"""Ledger by scan, off-policy evaluation and bootstrap intervals against plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricewright.functions.numbers import mixed_unit, product_number
from pricewright.operators import evaluate, intervals
from pricewright.operators.ledger import stock_ledger
from pricewright.operators.ledger_scan import stock_ledger_scan
from pricewright.params import EpisodeParams


@pytest.mark.parametrize("restock", [0, 7, 300])
def test_scan_equals_fold(spark, restock):
    """Gaps, jumps over stretches of every level, negative and huge demand, a product of one day."""
    draw, rows = random.Random(restock), []
    for product, first, n in (("a", -5000, 400), ("b", 0, 1), ("c", 4090, 150), ("d", 10_000, 260)):
        day = first
        for _ in range(n):
            day += draw.choice([1, 1, 1, 2, 63, 64]) if draw.random() < 0.98 else 5000
            rows.append((product, dt.date(1970, 1, 1) + dt.timedelta(days=day), draw.choice([0.0, 3.7, 20.0, 90.0, 5e9]), 1.5))
    days = spark.createDataFrame(rows, "product_id string, date date, demand double, price double")
    params = EpisodeParams(max_inventory=100, restock=restock)
    columns = ["product_id", "date", "step", "units_sold", "lost_units", "inventory_before", "inventory", "raw_reward"]
    got = stock_ledger_scan(days, ["product_id"], "date", params, start_inventory=40)
    want = stock_ledger(days, ["product_id"], "date", params, start_inventory=40)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
    assert stock_ledger_scan(days.limit(0), ["product_id"], "date", params).collect() == []


def test_scan_deals_one_product_over_tasks(spark):
    days = spark.range(20_000).select(F.lit("hot").alias("product_id"), F.col("id").alias("at"), (F.col("id") % 40).cast("double").alias("demand"), F.lit(1.0).alias("price"))
    params = EpisodeParams(max_inventory=50, restock=18)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test is small; a cluster's data is not
    try:
        got = stock_ledger_scan(days, ["product_id"], "at", params)
        tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("inventory")).count()
        assert tasks > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stock = params.max_inventory
    for r in got.orderBy("at").collect():
        assert (r.step, r.inventory_before) == (r["at"], stock)
        stock = min(50, max(0, stock - r["at"] % 40) + 18)


def test_off_policy_figures(spark):
    draw, rows = random.Random(3), []
    for _ in range(400):
        product, state = draw.choice("ab"), draw.randrange(3)
        rows.append((product, state, draw.choice([0, 1, 1, 2]), draw.uniform(-1, 3)))
    rows += [("c", 0, 1, 2.0), ("c", 1, 5, 4.0), ("d", 0, 4, 1.0), ("e", 0, 5, 1.0)]
    best = [("a", 0, 1), ("a", 1, 2), ("b", 0, 0), ("b", 2, 1), ("c", 0, 2), ("d", 0, 3)]
    q = [(p, s, a, draw.uniform(0, 2)) for p in "ab" for s in range(3) for a in range(3) if draw.random() < 0.8]
    q += [("c", 0, 2, 1.0), ("d", 0, 3, 0.5)]
    got = evaluate.off_policy_evaluation(
        spark.createDataFrame(rows, "product_id string, state int, action int, reward double"),
        spark.createDataFrame(best, "product_id string, state int, action int"),
        spark.createDataFrame(q, "product_id string, state int, action int, q double"),
        ["product_id"],
    )
    policy, model = {(p, s): a for p, s, a in best}, {(p, s, a): v for p, s, a, v in q}
    for r in got.collect():
        own = [x for x in rows if x[0] == r.product_id]
        usual = [v for (p, *_), v in model.items() if p == r.product_id]

        def value(s, a):
            return model.get((r.product_id, s, a), sum(usual) / len(usual) if usual else None)

        weights = []
        for _, s, a, _ in own:
            here = [x for x in own if x[1] == s]
            odds = sum(x[2] == a for x in here) / len(here)
            weights.append(1 / odds if policy.get((r.product_id, s), 5) == a else 0)
        total = sum(weights)
        assert r.n_steps == len(own) and r.n_agreeing == sum(w > 0 for w in weights)
        assert r.reason == ("no_model" if not usual else "none" if total else "no_agreement")
        if total:
            assert r.weighted_reward == pytest.approx(sum(w * x[3] for w, x in zip(weights, own)) / total)
            assert r.effective_steps == pytest.approx(total**2 / sum(w * w for w in weights))
        if usual:
            direct = sum(value(s, policy.get((r.product_id, s), 5)) for _, s, _, _ in own) / len(own)
            assert r.model_reward == pytest.approx(direct)
            if total:
                errors = sum(w * (x[3] - value(x[1], x[2])) for w, x in zip(weights, own)) / total
                assert r.corrected_reward == pytest.approx(direct + errors)
    assert {r.product_id for r in got.collect()} == set("abcde")


def test_intervals_are_those_of_a_loop(spark):
    draw = random.Random(1)
    rows = [(policy, str(p), e, draw.gauss(m, 1)) for policy, m in (("x", 1.0), ("y", 1.1), ("z", 5.0)) for p in range(4) for e in range(6)]
    totals = spark.createDataFrame(rows, "policy string, product_id string, episode int, total_reward double")
    draws = spark.range(4).crossJoin(spark.range(6).toDF("e")).crossJoin(spark.range(40).toDF("r")).select(
        "id", "e", "r", mixed_unit(product_number(F.col("id").cast("string")), F.col("e"), F.col("r"), 17).alias("u")
    )
    u = {(str(r["id"]), r["e"], r["r"]): r["u"] for r in draws.collect()}
    sums = defaultdict(list)
    for policy, p, e, x in rows:
        for r in range(40):
            w = sum(u[p, e, r] >= limit for limit in intervals.POISSON)
            sums[policy, p, r] += [x] * w
    means = {k: sum(v) / len(v) for k, v in sums.items() if v}
    made = intervals.replicated_means(totals, replicates=40)
    assert {(r.policy, r.product_id, r.replicate): pytest.approx(r["mean"]) for r in made.collect()} == means
    for r in intervals.product_intervals(made).collect():
        own = sorted(v for (policy, p, _), v in means.items() if (policy, p) == (r.policy, r.product_id))
        out = int(len(own) * 0.05)
        assert (r.low, r.high, r.n_replicates) == (pytest.approx(own[out]), pytest.approx(own[len(own) - out - 1]), len(own))
    board = {r.policy: r for r in intervals.policy_intervals(made).collect()}
    assert board["z"].first_share == 1.0 and board["z"].mean_rank == 1.0
    assert board["x"].low < board["x"].high < board["z"].low
    assert sum(r.first_share for r in board.values()) == pytest.approx(1.0)


def test_bootstrap_weights_have_mean_one(spark):
    drawn = spark.range(20_000).select(intervals.weight(F.lit("5"), F.col("id"), F.lit(3)).alias("w"))
    mean, spread = drawn.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 0.03 and abs(spread - 1) < 0.05
