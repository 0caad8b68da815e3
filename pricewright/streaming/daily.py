"""Continuous daily demand and stock ledger over a stream of sales lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import EpisodeParams

LEDGER_SCHEMA = (
    "StockCode string, Date date, demand double, price double, units_sold bigint, lost_units bigint, "
    "revenue double, raw_reward double, inventory_before bigint, inventory bigint"
)


def read_lines(spark: SparkSession, directory: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parquet files appearing in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def daily_demand_stream(transactions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily demand per product in append mode: a day is emitted once it is closed.

    The watermark is kept on the day itself, so days follow the session time zone.
    A day closes when a line ``delay`` later has been seen; lines for closed days are
    late and left out.
    """
    day = F.date_trunc("DAY", F.col("InvoiceDate").cast("timestamp"))
    return (
        transactions.withColumn("day", day)
        .withWatermark("day", delay)
        .groupBy("StockCode", "day")
        .agg(F.avg("Price").alias("avg_price"), F.sum("Quantity").alias("total_qty"))
        .select("StockCode", F.to_date("day").alias("Date"), "avg_price", "total_qty", "day")
    )


def stock_ledger_stream(daily: DataFrame, params: EpisodeParams = EpisodeParams(), start_inventory: int | None = None) -> DataFrame:
    """Stock ledger per product over closed days; the state is the stock of each product.

    ``daily`` is a stream over the folder ``daily_demand_stream`` is written to (Spark
    allows no state of one's own behind an aggregate within one stream).  The file
    sink commits whole micro-batches and days close in order, so a later batch holds no
    earlier day unless the number of files per trigger is limited.  The days a batch brings for a product
    are booked in date order; the state keeps the last one, and a day that is not after it ends the
    stream with an error instead of being booked out of order.
    """
    p = params
    opening = p.max_inventory if start_inventory is None else start_inventory

    def book(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(batches)).sort_values("Date")
        stock, last = state.get if state.exists else (opening, None)
        if last is not None and days["Date"].iloc[0] <= last:
            raise ValueError(f"{key[0]}: {days['Date'].iloc[0]} arrives after {last} has been booked")
        wanted = days["total_qty"].astype(float).astype(int).to_numpy()
        before, sold, after = [], [], []
        for units in wanted:
            before.append(stock)
            sold.append(min(int(units), stock))
            stock = min(p.max_inventory, max(0, stock - sold[-1]) + p.restock)
            after.append(stock)
        state.update((stock, days["Date"].iloc[-1]))
        out = pd.DataFrame(
            {
                "StockCode": key[0],
                "Date": days["Date"].to_numpy(),
                "demand": days["total_qty"].to_numpy(),
                "price": days["avg_price"].to_numpy(),
                "units_sold": sold,
                "inventory_before": before,
                "inventory": after,
            }
        )
        out["lost_units"] = (wanted - out["inventory_before"]).clip(lower=0)
        out["revenue"] = out["units_sold"] * out["price"]
        out["raw_reward"] = (
            out["revenue"] - p.stockout_penalty * out["lost_units"] - p.overstock_penalty * out["inventory_before"]
        )
        yield out[[f.split()[0] for f in LEDGER_SCHEMA.split(", ")]]

    return daily.groupBy("StockCode").applyInPandasWithState(
        book,
        outputStructType=LEDGER_SCHEMA,
        stateStructType="inventory bigint, last date",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all data there is, append it to parquet at ``path``, and stop."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
