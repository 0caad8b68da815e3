"""What grows with the input: tasks, work per row, copies on disk."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from pricewright import plans
from pricewright.plans import base
from pricewright.session import tasks_for


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tasks_follow_the_rows(spark):
    rows = spark.range(100_000)
    assert tasks_for(rows, 1_000) == 100
    assert tasks_for(rows.limit(0)) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["transition_table", "external_model_levels", "united_policy_results"])
def test_logged_days_are_dealt_over_as_many_tasks_as_their_rows_need(spark, small_dir, monkeypatch, name):
    monkeypatch.setattr(base, "tasks_for", lambda lines: 37)
    assert "hashpartitioning(StockCode" in plan_of(plans.QUERIES[name](spark, small_dir))
    assert ", 37), REPARTITION_BY_NUM" in plan_of(plans.QUERIES[name](spark, small_dir))


def test_values_and_choices_of_stored_transitions_share_a_dealing_that_follows_the_lines(spark, small_dir, monkeypatch):
    monkeypatch.setattr(base, "tasks_for", lambda lines: 37)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plans.QUERIES["epsilon_greedy_actions"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line.split(" Exchange ")[1] for line in plan.splitlines() if " Exchange " in line]
    assert len(exchanges) == 2 and all("37), REPARTITION_BY_NUM" in e and "(product_id" in e and "state" in e for e in exchanges)


def test_a_batch_of_rows_holds_many_episodes_of_a_stateful_policy(spark):
    from pricewright.operators import stateful

    def make():
        class Memory:
            def __init__(self):
                self.rows = []

            def act(self, step):
                self.rows.append((step["n"], step.n, step[3]))
                return len(self.rows)

        return Memory()

    rows = [(None if e == 3 else str(e), s, "x", 1.5) for e in range(200) for s in reversed(range(3))]
    steps = spark.createDataFrame(rows, "e string, s int, other string, n double")
    chosen = stateful.stateful_levels(steps, ["e"], "s", make, partitions=2)
    assert "MapInArrow" in plan_of(chosen)
    assert sorted((r.e or "", r.s, r.action) for r in chosen.collect()) == sorted((e or "", s, s + 1) for e, s, _, _ in rows)


def test_bootstrap_works_out_the_weights_of_a_row_once(spark):
    from pricewright.functions.numbers import mixed_unit, product_number, with_episode_hash, with_step_unit
    from pricewright.operators import intervals

    rows = [("x", str(p), e, float(p - e)) for p in range(5) for e in range(4)] + [("x", None, 0, 1.0), ("y", "7", None, 1.0), ("y", "c", -3, None)]
    totals = spark.createDataFrame(rows, "policy string, product_id string, episode int, total_reward double")
    optimized = intervals.replicated_means(totals)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("crc32(") == 1
    both = with_episode_hash(totals, product_number(F.col("product_id")), F.col("episode"), 17).withColumn("r", F.explode(F.array(*map(F.lit, range(9)))))
    both = with_step_unit(both, F.col("r"), "u").withColumn("v", mixed_unit(product_number(F.col("product_id")), F.col("episode"), F.col("r"), 17))
    assert both.filter("not u <=> v").count() == 0 and both.filter("u is not null").count() > 100


def small_dataset(spark, n_products, n_days):
    from pricewright.sources import driver_tables as D

    first = dt.date(2024, 1, 1)
    lines = [("1", str(p), "3", f"{2 + d % 5}.5", f"{first + dt.timedelta(days=d)} 08:00:00") for p in range(3) for d in range(40)]
    rows = [(f"T{i:03d}", "n", "Other", 5.0, -1.0, 30.0, 2.5, 10.0, 0.1, i) for i in range(n_products)]
    kinds = "product_id string, name string, category string, base_price double, elasticity double, base_demand double, price_min double, price_max double, noise_std double, template_no long"
    transactions = spark.createDataFrame(lines, "Invoice string, StockCode string, Quantity string, Price string, InvoiceDate string")
    return transactions, D.season_parameters(spark.createDataFrame(rows, kinds), "template_no")


def test_days_of_unlogged_products_are_made_where_they_are_written(spark, tmp_path):
    from pricewright.sources import catalogue as S
    from pricewright.sources import dataset

    transactions, templates = small_dataset(spark, 60, 50)
    order = [F.col("template_no").asc()]
    transactions.write.option("header", True).csv(str(tmp_path / "lines"))
    products, series = dataset.dataset_from_csv(spark, str(tmp_path / "lines"), templates, order, str(tmp_path / "data"), n_days=50)
    # Every listed product is there, and no join shuffles the days.
    assert "Join" not in series._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.product_id: r.n for r in series.groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    assert sorted(counts) == sorted(r.product_id for r in products.collect()) and len(counts) == 60
    assert sorted(counts.values()) == [40] * 3 + [50] * 57
    _, whole = dataset.build_dataset(transactions, templates, order, n_days=50)
    assert series.exceptAll(whole).count() == whole.exceptAll(series).count() == 0
    for product in ("1", "T042"):
        assert S.find_series(spark, str(tmp_path / "data"), product).count() == counts[product]


def test_made_series_are_stored_without_what_their_own_figures_give(spark, tmp_path):
    """Every day has its row and comes back bit by bit, in less than half of the three doubles it holds."""
    from pricewright.sources import catalogue as S
    from pricewright.sources import dataset

    transactions, templates = small_dataset(spark, 200, 700)
    templates = templates.withColumn("base_demand", F.col("template_no") / 7 + 0.1).withColumn("base_price", F.col("template_no") / 3 + 0.7)
    order = [F.col("template_no").asc()]
    transactions.write.option("header", True).csv(str(tmp_path / "lines"))
    _, series = dataset.dataset_from_csv(spark, str(tmp_path / "lines"), templates, order, str(tmp_path / "data"), n_days=700)
    _, whole = dataset.build_dataset(transactions, templates, order, n_days=700)
    assert series.dtypes == whole.dtypes and series.count() == 3 * 40 + 197 * 700
    assert series.exceptAll(whole).count() == whole.exceptAll(series).count() == 0
    stored = sum(f.stat().st_size for f in (tmp_path / "data").rglob("*.parquet"))
    assert stored / series.count() < 12
    files = spark.read.parquet(f"{tmp_path}/data/versions/*/{S.SERIES_DIR}")
    assert files.count() == series.count()


@pytest.mark.parametrize("made", [False, True])
def test_stored_series_come_back_bit_by_bit(spark, tmp_path, made):
    from itertools import product

    from pricewright.sources import catalogue as S

    odd = [None, 0.0, -0.0, 1.0, 0.1, 1 / 3, -7.3, 1e308, 5e-324, 2.0**53 + 2, float("nan"), float("inf"), float("-inf")]
    days = [(str(i % 5), dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 7, None, p, d, r, s) for i, (p, d, r, s) in enumerate(product(odd[:6] + odd[10:], odd, [None, 0.0, 2.5], odd))]
    days += [("7", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0, i, 1.1 * i, 0.3 * i * (1 + i / 9), 1.1 * i * (0.3 * i * (1 + i / 9)), 1 + i / 9) for i in range(300)]
    days += 2 * [(None, None, None, None, None, None, None, None)]
    names = ["product_id", *S.SERIES_SCHEMA.names]
    series = spark.createDataFrame(days, f"product_id string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in S.SERIES_SCHEMA)}")
    listed = spark.createDataFrame([(str(i), "n") for i in [0, 1, 2, 3, 4, 7]] + [(None, "n")], "product_id string, name string")

    def bits(rows):
        return sorted(str([struct.pack(">d", v).hex() if isinstance(v, float) else v for v in r]) for r in rows)

    if made:
        # A product's days travel in one row and are made out of it where they are written.
        folded = series.groupBy("product_id").agg(F.collect_list(F.struct(*S.SERIES_SCHEMA.names)).alias("days"))
        S.save_products(listed, series.limit(0), str(tmp_path / "d"), unfolded=(folded, lambda f: f.select("product_id", F.inline("days"))))
    else:
        S.save_products(listed, series, str(tmp_path / "d"))
    found = S._unpacked(spark.read.parquet(f"{tmp_path}/d/versions/*/{S.SERIES_DIR}"))
    assert found.columns == names and bits(found.collect()) == bits(days)
    assert bits(S.find_series(spark, str(tmp_path / "d"), 7).collect()) == bits(d for d in days if d[0] == "7")


def test_versions_that_hold_demand_and_revenue_plainly_are_read(spark, tmp_path):
    from pricewright.sources import catalogue as S
    from pricewright.sources import versions

    day = (dt.date(2024, 1, 1), 0, 1, 1.0, 2.0, 2.0, 1.0)
    series = spark.createDataFrame([("a", *day)], f"product_id string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in S.SERIES_SCHEMA)}")

    def write(folder):
        series.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{folder}/{S.SERIES_DIR}")
        spark.createDataFrame([("a", "n")], "id string, name string").write.json(f"{folder}/{S.CATALOGUE_DIR}")
        return {"buckets": 1, "rows": 1}

    versions.commit(spark, str(tmp_path), write)
    for days in (S.load_products(spark, str(tmp_path))[1], S.find_series(spark, str(tmp_path), "a")):
        assert days.columns == series.columns and [tuple(r) for r in days.collect()] == [("a", *day)]


def test_series_of_products_that_are_not_listed_stay_out(spark, tmp_path):
    from pricewright.sources import catalogue as S

    day = (dt.date(2024, 1, 1), 0, 1, 1.0, 2.0, 2.0, 1.0)
    series = spark.createDataFrame([("a", *day), ("b", *day), (None, *day)], f"product_id string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in S.SERIES_SCHEMA)}")
    S.save_products(spark.createDataFrame([("a", "n")], "product_id string, name string"), series, str(tmp_path / "d"))
    assert [r.product_id for r in S.load_products(spark, str(tmp_path / "d"))[1].collect()] == ["a"]


def test_packing_remembers_as_many_cuttings_as_it_is_told(spark):
    from pricewright.llm import packing
    from pricewright.llm.tokens import tokenizer_path

    docs = spark.createDataFrame([(i, f"some words w{i} and w{i * 7} again") for i in range(50)] + [(50, None)], "doc_id long, text string")
    few, many = (packing.pack(docs, tokenizer_path("word_bpe_49k.json"), known=n).collect() for n in (0, 1000))
    assert len(few) == 51 and sorted(map(tuple, few)) == sorted(map(tuple, many))
