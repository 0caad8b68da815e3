"""The stock ledger as a prefix scan: for histories too long to be one array or one task.

A day takes the stock x to min(h, max(l, x + c)), and two such days in a row are again of that form.  So a stretch of days is three
numbers, whatever its length.  Days are cut into stretches of ``WIDTH`` by their date, stretches into longer ones, and so on;
inside each, what leads up to a row comes from ``ROUNDS`` steps of doubling by lag.  The openings then go back
down: each stretch learns its opening stock from the one above it.  A product's days are dealt over tasks by stretch, and
nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pricing as P
from ..params import EpisodeParams
from ..session import write_once

WIDTH = 64
ROUNDS = 6  # 2 ** ROUNDS == WIDTH
LEVELS = 2  # stretches of 64 and 4,096 days; above them, 64 of the longest


def _then(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Low, high and shift of one stretch of days followed by another."""
    low, high, shift = second

    def through(x: Column) -> Column:
        return F.least(high, F.greatest(low, x + shift))

    return through(first[0]), through(first[1]), first[2] + shift


def _through(stock: Column, low: Column, high: Column, shift: Column) -> Column:
    return F.least(high, F.greatest(low, stock + shift))


def _prefixes(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``_low, _high, _shift`` and ``_n`` of each row become those of all rows of its group up to it."""
    window = Window.partitionBy(*group).orderBy(order)
    names = ("_low", "_high", "_shift")
    for k in range(ROUNDS):
        before = [F.lag(n, 1 << k).over(window) for n in names]
        rows = rows.select("*", *[b.alias(f"_before{n}") for n, b in zip(names, before)])
        joint = _then(tuple(F.col(f"_before{n}") for n in names), tuple(F.col(n) for n in names))
        known = F.col("_before_shift").isNotNull()
        merged = {n: F.when(known, j).otherwise(F.col(n)) for n, j in zip(names, joint)}
        rows = rows.withColumns(merged).drop(*[f"_before{n}" for n in names])
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n", F.sum("_n").over(frame))


def _opened(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``_open`` and ``_at`` of a row: stock and number of days before it, from those of its group."""
    window = Window.partitionBy(*group).orderBy(order)
    low, high, shift, n = (F.lag(c).over(window) for c in ("_low", "_high", "_shift", "_n"))
    opened = rows.select("*", low.alias("_l"), high.alias("_h"), shift.alias("_s"), n.alias("_m"))
    first = F.col("_s").isNull()
    stock = F.when(first, F.col("_opening")).otherwise(_through(F.col("_opening"), F.col("_l"), F.col("_h"), F.col("_s")))
    return opened.withColumn("_open", stock).withColumn("_at", F.col("_before") + F.coalesce("_m", F.lit(0))).drop("_l", "_h", "_s", "_m")


def stock_ledger_scan(
    demand: DataFrame, keys: list[str], order: str, params: EpisodeParams = EpisodeParams(), start_inventory: int | None = None
) -> DataFrame:
    """The rows of ``stock_ledger`` for ``demand`` and ``price`` in ``order``, a date or a whole number, once per ``keys``.

    A history may span 262,144 days or numbers.
    """
    p = params
    opening = p.max_inventory if start_inventory is None else start_inventory
    day = F.unix_date(order) if dict(demand.dtypes)[order] == "date" else F.col(order)
    wanted = P.whole_units(F.col("demand"))
    rows = demand.select(*keys, order, F.col("demand").cast("double").alias("demand"), "price", day.cast("bigint").alias("_day")).select(
        "*",
        *[F.floor(F.col("_day") / F.lit(WIDTH**k)).cast("bigint").alias(f"_b{k}") for k in range(1, LEVELS + 1)],
        # max(0, x - wanted) + restock, at most max_inventory
        F.least(F.lit(p.max_inventory), F.lit(p.restock)).cast("bigint").alias("_low"),
        F.lit(p.max_inventory).cast("bigint").alias("_high"),
        (F.lit(p.restock) - wanted).alias("_shift"),
        F.lit(1).cast("bigint").alias("_n"),
    )
    groups = [[*keys, f"_b{k}"] for k in range(1, LEVELS + 1)] + [list(keys)]
    orders = ["_day", *[f"_b{k}" for k in range(1, LEVELS + 1)]]
    # Each level is written once: it is read on the way up and on the way down.
    up = [write_once(_prefixes(rows, groups[0], orders[0]), "ledger-days")]
    for k in range(1, LEVELS + 1):
        last = F.max_by(F.struct("_low", "_high", "_shift", "_n"), orders[k - 1]).alias("_last")
        above = [f"_b{j}" for j in range(k, LEVELS + 1)]
        whole = up[-1].groupBy(*keys, *above).agg(last).select(*keys, *above, "_last.*")
        up.append(write_once(_prefixes(whole, groups[k], orders[k]), "ledger-stretches"))
    down = up[-1].withColumn("_opening", F.lit(opening).cast("bigint")).withColumn("_before", F.lit(0).cast("bigint"))
    for k in range(LEVELS, 0, -1):
        known = _opened(down, groups[k], orders[k]).select(*groups[k - 1], F.col("_open").alias("_opening"), F.col("_at").alias("_before"))
        down = up[k - 1].join(known, groups[k - 1])
    booked = _opened(down, groups[0], orders[0])
    before = F.col("_open")
    sold, lost = P.units_sold(F.col("demand"), before), P.lost_units(F.col("demand"), before)
    return booked.select(
        *keys,
        order,
        F.col("_at").cast("int").alias("step"),
        "demand",
        "price",
        sold.alias("units_sold"),
        lost.alias("lost_units"),
        (sold * F.col("price")).alias("revenue"),
        P.step_reward(sold, F.col("price"), lost, before, p.stockout_penalty, p.overstock_penalty).alias("raw_reward"),
        before.alias("inventory_before"),
        P.next_inventory(before, sold, p.restock, p.max_inventory).alias("inventory"),
    )
