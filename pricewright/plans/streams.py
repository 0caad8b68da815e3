"""Registered queries: the streaming forms, run over all data there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..params import EpisodeParams
from ..session import fresh_path
from ..sources import driver_tables as D
from ..streaming import daily as S
from ..streaming import open_days as O
from . import base as B
from .registry import cte, query
from .sql import rnd, whole

cte(
    "numbered_days",
    """SELECT *, row_number() OVER (PARTITION BY "StockCode" ORDER BY "Date") - 1 AS row_index FROM daily_supplier""",
)
cte(
    "streamed_ledger",
    f"""
    WITH RECURSIVE r AS (
      SELECT "StockCode", CAST(-1 AS BIGINT) AS step, 60::BIGINT AS inventory, CAST(NULL AS DATE) AS "Date", 0e0 AS demand,
             0::BIGINT AS units_sold, 0::BIGINT AS lost_units, 60::BIGINT AS inventory_before
      FROM numbered_days WHERE row_index = 0
      UNION ALL
      SELECT r."StockCode", i.row_index,
             least(60, greatest(0, r.inventory - least({whole('i.total_qty')}, r.inventory)) + 15),
             i."Date", i.total_qty, least({whole('i.total_qty')}, r.inventory),
             greatest(0, {whole('i.total_qty')} - r.inventory), r.inventory
      FROM r JOIN numbered_days i ON i."StockCode" = r."StockCode" AND i.row_index = r.step + 1
    )
    SELECT * FROM r WHERE step >= 0""",
)


TIGHT = EpisodeParams(max_inventory=60, restock=15)


def _streamed(spark, sf_dir):
    """Run the stream over the line table and read back the last word on every day."""
    path = fresh_path(spark, "open-days")
    schema = D.table(spark, sf_dir, "lineitem").schema
    lines = S.read_lines(spark, sf_dir, schema, pattern="lineitem.parquet")
    days = O.open_days_stream(clean.clean_rows(D.as_transactions(lines)), TIGHT)
    O.run_stateful(days, f"{path}/days", f"{path}/progress")
    return O.current_days(spark.read.schema(O.OUT).parquet(f"{path}/days"))


@query(
    "Q1",
    f"""SELECT "StockCode", "Date", {rnd('avg_price')} AS avg_price, {rnd('total_qty')} AS total_qty FROM daily_supplier""",
)
def streamed_daily_demand(spark, sf_dir):
    """Every day there is: those the watermark has closed and those still open."""
    return B.rounded(_streamed(spark, sf_dir).select("StockCode", "Date", "avg_price", "total_qty"))


@query(
    "Q1, R6",
    f"""SELECT "StockCode", "Date", {rnd('demand')} AS demand, units_sold, lost_units, inventory_before, inventory
        FROM streamed_ledger""",
)
def streamed_stock_ledger(spark, sf_dir):
    """Stock over every day there is; open days are booked behind the closed ones."""
    days = _streamed(spark, sf_dir).withColumnRenamed("total_qty", "demand")
    return B.rounded(days.select("StockCode", "Date", "demand", "units_sold", "lost_units", "inventory_before", "inventory"))


@query(
    "Q1",
    """SELECT "Date" >= (SELECT max("Date") FROM clean_supplier) AS open, count(*) AS n_days,
       count(DISTINCT "StockCode") AS n_products FROM daily_supplier GROUP BY 1""",
)
def streamed_open_days(spark, sf_dir):
    """How many days are still open to late lines, and how many are closed."""
    days = _streamed(spark, sf_dir)
    return days.groupBy((~F.col("closed")).alias("open")).agg(
        F.count("*").alias("n_days"), F.countDistinct("StockCode").alias("n_products")
    )
