"""Rows told apart by a list."""

import pytest
from pyspark.sql import functions as F

from pricewright.llm import filters
from pricewright.llm.common import written


@pytest.mark.parametrize("part", [4_000_000, 700])
def test_listed_rows_all_pass_and_few_others(spark, part):
    rows = spark.range(30_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    mark = F.xxhash64("text")
    listed = written(rows.where("id % 11 = 0").select(mark.alias("mark")), "listed")
    clean, maybe = filters.told_apart(rows, mark, listed, part)
    assert clean.where("id % 11 = 0").count() == 0 and maybe.where("id % 11 = 0").count() == 2728
    assert clean.count() + maybe.count() == 30_000 and maybe.count() < 2728 + 300
    assert clean.columns == maybe.columns == rows.columns
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0] and "Python" not in plan


def test_empty_list_and_table(spark):
    rows = spark.range(10).toDF("id")
    none = written(spark.createDataFrame([], "mark bigint"), "listed")
    clean, maybe = filters.told_apart(rows, F.xxhash64("id"), none)
    assert clean.count() == 10 and maybe.count() == 0
    some = written(spark.createDataFrame([(1,), (1,)], "mark bigint"), "listed")
    clean, maybe = filters.told_apart(rows.limit(0), F.xxhash64("id"), some)
    assert clean.count() == maybe.count() == 0
