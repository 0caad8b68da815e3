"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import clean, demand
from ..params import EpisodeParams
from ..session import tasks_for
from ..sources import driver_tables as D

# Small enough for stock-outs to happen on the test tables.
TIGHT = EpisodeParams(max_inventory=40, restock=20)
EPISODES = 5  # random starts a product, of the queries that plan or draw episodes


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns, which is all the comparison of two engines needs."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        places = special.get(name, digits)
        out.append(half_up(column, places).alias(name) if kind == "double" and places is not None else column)
    return df.select(*out)


def cleaned(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    return clean.clean_rows(D.transactions(spark, sf_dir, grain))


def daily(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    return demand.daily_demand(cleaned(spark, sf_dir, grain))


def fitted(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    return demand.elasticity_catalogue(cleaned(spark, sf_dir, grain))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.described_catalogue(fitted(spark, sf_dir), spark, sf_dir)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.product_series(daily(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with the catalogue's figures on each day, from one scan of the lines.

    Days are dealt by product over a number of tasks that follows the lines; fit, ledger and histories keep that dealing.
    """
    days = daily(spark, sf_dir).repartition(tasks(spark, sf_dir), "StockCode")
    return D.described_catalogue(demand.priced_series(days), spark, sf_dir)


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks hold the daily table, which has no more rows than there are lines."""
    return tasks_for(lines(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem")
