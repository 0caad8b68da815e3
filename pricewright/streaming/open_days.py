"""Daily demand and stock as one stream that hides no day.

Lines are summed per product and day where they are read, then each product keeps its open days and its stock as one
value state, the days packed into an array.  Every batch emits the open days it knows as provisional rows; an event-time timer
closes the days the watermark has passed, books them for good and emits them as closed.  ``current_days`` picks the
last word on each day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import EpisodeParams
from .daily import run_available

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTIAL = "StockCode string, day timestamp, at bigint, price_sum double, n bigint, qty double"
_OPEN = np.dtype([("at", "<i8"), ("price_sum", "<f8"), ("n", "<i8"), ("qty", "<f8")])
_BOOK = "stock bigint, last bigint, revision bigint, timer bigint, days binary"
_NEVER = -(1 << 62)
OUT = (
    "StockCode string, Date date, avg_price double, total_qty double, units_sold bigint, lost_units bigint, revenue double, "
    "raw_reward double, inventory_before bigint, inventory bigint, closed boolean, revision bigint"
)
_NAMES = [f.strip().split()[0] for f in OUT.split(",")]


def summed_lines(transactions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Partial sums of cleaned lines per product and day, one row of each per Arrow batch, with a watermark on the day.

    A product with a third of all lines sends a row per day and batch, not its lines.
    """
    day = F.date_trunc("DAY", F.col("InvoiceDate").cast("timestamp"))
    rows = transactions.select("StockCode", day.alias("day"), F.unix_millis(day).alias("at"), "Price", "Quantity")
    names = ["StockCode", "day", "at"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(names).aggregate([("Price", "sum"), ("Price", "count"), ("Quantity", "sum")])
            sums = sums.rename_columns([*names, "price_sum", "n", "qty"])
            yield from sums.combine_chunks().to_batches()

    typed = rows.withColumn("Price", F.col("Price").cast("double")).withColumn("Quantity", F.col("Quantity").cast("double"))
    return typed.mapInArrow(add, _PARTIAL).withWatermark("day", delay)


class OpenDays(StatefulProcessor):
    """Open days and stock of one product."""

    def __init__(self, opening: int, restock: int, most: int, stockout_penalty: float, overstock_penalty: float):
        self.opening, self.restock, self.most = opening, restock, most
        self.penalties = stockout_penalty, overstock_penalty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", _BOOK)

    def close(self) -> None:
        pass

    def _state(self):
        """The open days in order, and stock, last closed day, revision and timer."""
        stock, last, revision, timer, days = self.book.get() or (self.opening, _NEVER, 0, _NEVER, b"")
        return np.frombuffer(bytes(days), _OPEN), stock, last, revision, timer

    def _kept(self, days: np.ndarray, stock: int, last: int, revision: int, timer: int) -> None:
        """Write the state back, with a timer for the first open day."""
        first = int(days["at"][0]) if len(days) else _NEVER
        if first != timer and len(days):
            self.handle.registerTimer(first)
        self.book.update((stock, last, revision, first, days.tobytes()))

    def _added(self, days: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        """The open days with the sums of ``rows`` added to them."""
        at = np.concatenate([days["at"], rows["at"].to_numpy(np.int64)])
        found, place = np.unique(at, return_inverse=True)
        out = np.empty(len(found), _OPEN)
        out["at"] = found
        for name in ("price_sum", "n", "qty"):
            parts = np.concatenate([days[name].astype(np.float64), rows[name].to_numpy(np.float64)])
            out[name] = np.bincount(place, parts, len(found))
        return out

    def _rows(self, key: tuple, days: np.ndarray, closed: bool, stock: int, revision: int) -> tuple[pd.DataFrame, int]:
        """Ledger rows of the days, closed or provisional, and the stock after them."""
        all_before, all_sold, all_lost, after = [], [], [], []
        for qty in days["qty"].tolist():
            wanted, before = int(qty), stock
            sold = min(wanted, before)
            stock = min(self.most, max(0, before - sold) + self.restock)
            all_before.append(before)
            all_sold.append(sold)
            all_lost.append(max(0, wanted - before))
            after.append(stock)
        before, sold, lost = (np.array(x, np.int64) for x in (all_before, all_sold, all_lost))
        price = days["price_sum"] / days["n"]
        revenue = sold * price
        columns = [
            key[0], days["at"].astype("datetime64[ms]").astype("datetime64[D]").astype(object), price, days["qty"], sold, lost, revenue,
            revenue - self.penalties[0] * lost - self.penalties[1] * before, before, np.array(after, np.int64), closed, revision,
        ]
        return pd.DataFrame(dict(zip(_NAMES, columns)), index=range(len(days))), stock

    def handleInputRows(self, key, rows, timerValues):
        days, stock, last, revision, timer = self._state()
        new = pd.concat(list(rows))
        days = self._added(days, new[new["at"] > last])  # a line for a closed day is late and left out
        self._kept(days, stock, last, revision + 1, timer)
        found, _ = self._rows(key, days, False, stock, revision + 1)
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        days, stock, last, revision, _ = self._state()
        closed, still = days[days["at"] <= mark], days[days["at"] > mark]
        found, stock = self._rows(key, closed, True, stock, revision)
        self._kept(still, stock, max([last, *closed["at"][-1:].tolist()]), revision, _NEVER)
        yield found


def open_days_stream(transactions: DataFrame, params: EpisodeParams = EpisodeParams(), start_inventory: int | None = None, delay: str = "1 day") -> DataFrame:
    """Daily demand and stock of every product over a stream of cleaned lines, provisional rows first and closed ones later.

    Days follow UTC midnights of the session's time zone.  ``run_stateful`` starts it; the state needs RocksDB.
    """
    p = params
    opening = p.max_inventory if start_inventory is None else start_inventory
    keeper = OpenDays(opening, p.restock, p.max_inventory, p.stockout_penalty, p.overstock_penalty)
    return (
        summed_lines(transactions, delay)
        .groupBy("StockCode")
        .transformWithStateInPandas(keeper, outputStructType=OUT, outputMode="append", timeMode="EventTime")
    )


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all data there is with state in RocksDB, append it to parquet at ``path``, and stop."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        run_available(stream, path, checkpoint)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def current_days(emitted: DataFrame) -> DataFrame:
    """The last word on each product and day: the closed row, or else the newest provisional one."""
    rest = [c for c in _NAMES if c not in ("StockCode", "Date")]
    newest = F.max_by(F.struct(*rest), F.struct("closed", "revision"))
    return emitted.groupBy("StockCode", "Date").agg(newest.alias("_row")).select("StockCode", "Date", "_row.*")
