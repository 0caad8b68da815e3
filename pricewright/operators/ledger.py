"""The stock ledger over logged demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..params import EpisodeParams

LEDGER_TYPE = (
    "struct<step:int,demand:double,price:double,units_sold:bigint,lost_units:bigint,revenue:double,"
    "raw_reward:double,inventory_before:bigint,inventory:bigint>"
)


def stock_ledger(
    demand: DataFrame,
    keys: list[str],
    order: str,
    params: EpisodeParams = EpisodeParams(),
    start_inventory: int | None = None,
    segment: int = 30,
) -> DataFrame:
    """Replay logged ``demand`` at logged ``price`` against stock, in ``order`` within ``keys``.

    A key is one episode or one product's days, so the gathered array is bounded by
    the episode length or the calendar.  A fold copies its state at every step, which
    would make a ledger of n days cost n squared; so a first fold carries the stock
    alone and notes it every ``segment`` days, and the segments are then booked as
    independent rows.
    """
    p = params
    opening = p.max_inventory if start_inventory is None else start_inventory
    at = F.struct(F.col(order).alias("at"), F.col("demand").cast("double").alias("demand"), "price")

    def stock_after(stock: Column, day: Column) -> Column:
        return P.next_inventory(stock, P.units_sold(day["demand"], stock), p.restock, p.max_inventory)

    def pass_segment(state: Column, days: Column) -> Column:
        return F.struct(
            F.aggregate(days, state["stock"], stock_after).alias("stock"),
            F.array_append(state["openings"], state["stock"]).alias("openings"),
        )

    gathered = demand.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("_days"))
    firsts = F.sequence(F.lit(0), F.floor((F.size("_days") - 1) / F.lit(segment)).cast("int"))
    segments = gathered.withColumn(
        "_segments", F.transform(firsts, lambda i: F.slice("_days", i * segment + 1, F.lit(segment)))
    ).drop("_days")
    start = F.struct(F.lit(opening).cast("bigint").alias("stock"), F.array().cast("array<bigint>").alias("openings"))
    opened = segments.withColumn(
        "_openings", F.aggregate("_segments", start, pass_segment, lambda state: state["openings"])
    )
    rows = opened.select(
        *keys,
        F.posexplode_outer(F.arrays_zip(F.col("_openings").alias("opening"), F.col("_segments").alias("days"))).alias(
            "_number", "_segment"
        ),
    ).select(*keys, "_number", "_segment.*")

    first = F.struct(
        (F.col("_number") * F.lit(segment)).alias("step"),
        F.col("opening").alias("stock"),
        F.array().cast(f"array<{LEDGER_TYPE}>").alias("ledger"),
    )

    def book(state: Column, day: Column) -> Column:
        before = state["stock"]
        sold, lost = P.units_sold(day["demand"], before), P.lost_units(day["demand"], before)
        after = P.next_inventory(before, sold, p.restock, p.max_inventory)
        entry = F.struct(
            state["step"].alias("step"),
            day["demand"].alias("demand"),
            day["price"].alias("price"),
            sold.alias("units_sold"),
            lost.alias("lost_units"),
            (sold * day["price"]).alias("revenue"),
            P.step_reward(sold, day["price"], lost, before, p.stockout_penalty, p.overstock_penalty).alias("raw_reward"),
            before.alias("inventory_before"),
            after.alias("inventory"),
        )
        return F.struct(
            (state["step"] + 1).alias("step"),
            after.alias("stock"),
            F.array_append(state["ledger"], entry).alias("ledger"),
        )

    booked = rows.withColumn("_ledger", F.aggregate("days", first, book, lambda state: state["ledger"]))
    return booked.select(
        *keys, F.inline_outer(F.arrays_zip(F.col("days.at").alias(order), F.col("_ledger").alias("_entry")))
    ).select(*keys, order, "_entry.*")
