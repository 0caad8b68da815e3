"""The stream of open days: provisional rows, closing by timers, late lines, restarts."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricewright import plans
from pricewright.params import EpisodeParams
from pricewright.plans import base
from pricewright.streaming import daily, open_days

PARAMS = EpisodeParams(max_inventory=20, restock=6)
LINES = "Invoice string, StockCode string, Quantity double, Price double, InvoiceDate date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, folder, lines, number):
    """Add a file of lines and process what there is."""
    rows = [(f"i{number}", code, float(q), float(p), day(d)) for code, d, q, p in lines]
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = daily.read_lines(spark, f"{folder}/in", spark.createDataFrame([], LINES).schema)
    open_days.run_stateful(open_days.open_days_stream(stream, PARAMS), f"{folder}/out", f"{folder}/progress")
    return spark.read.schema(open_days.OUT).parquet(f"{folder}/out")


def booked(lines):
    """(product, day) to (mean price, quantity, sold, lost, stock before, stock after), by a plain loop."""
    sums = defaultdict(list)
    for code, d, q, p in lines:
        sums[code, d].append((q, p))
    out, stock = {}, defaultdict(lambda: PARAMS.max_inventory)
    for code, d in sorted(sums):
        qty, before = sum(q for q, _ in sums[code, d]), stock[code]
        sold = min(int(qty), before)
        stock[code] = min(PARAMS.max_inventory, before - sold + PARAMS.restock)
        out[code, day(d)] = (sum(p for _, p in sums[code, d]) / len(sums[code, d]), qty, sold, max(0, int(qty) - before), before, stock[code])
    return out


def last_words(emitted):
    rows = open_days.current_days(emitted).collect()
    return {(r.StockCode, r.Date): (r.avg_price, r.total_qty, r.units_sold, r.lost_units, r.inventory_before, r.inventory) for r in rows}, {
        (r.StockCode, r.Date) for r in rows if r.closed
    }


def test_days_are_provisional_first_and_closed_later(spark, tmp_path):
    folder = str(tmp_path)
    first = [("a", 0, 5, 1), ("a", 0, 3, 2), ("a", 1, 30, 1), ("b", 1, 2, 4), ("a", 3, 4, 1)]
    words, closed = last_words(run(spark, folder, first, 1))
    assert words == booked(first)
    # The watermark is a day behind the newest line.
    assert closed <= {("a", day(0)), ("a", day(1)), ("b", day(1)), ("a", day(2))} and ("a", day(0)) in closed
    assert ("a", day(3)) not in closed
    more = [("a", 3, 9, 3), ("b", 3, 1, 1), ("b", 4, 2, 2), ("c", 6, 50, 1)]
    words, closed = last_words(run(spark, folder, more, 2))
    assert words == booked(first + more)
    assert {("a", day(3)), ("b", day(3)), ("b", day(4))} <= closed and ("c", day(6)) not in closed
    late = [("a", 0, 100, 100), ("c", 6, 1, 3)]
    words, _ = last_words(run(spark, folder, late, 3))
    assert words == booked(first + more + late[1:])


def test_a_closed_day_is_never_changed(spark, tmp_path):
    folder, lines = str(tmp_path), [("a", d, d % 7 + 1, 1) for d in range(40)]
    for n in range(4):
        emitted = run(spark, folder, lines[n * 10 : n * 10 + 10], n)
    finals = emitted.where("closed").groupBy("StockCode", "Date").count()
    assert finals.where("count > 1").count() == 0 and finals.count() >= 36
    assert last_words(emitted)[0] == booked(lines)


@pytest.mark.parametrize("name", ["streamed_daily_demand", "streamed_stock_ledger"])
def test_streams_have_every_day(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    rows = plans.QUERIES[name](spark, sf_dir)
    days = base.daily(spark, sf_dir)
    assert rows.count() == days.count() == rows.select("StockCode", "Date").distinct().count()
    assert rows.agg(F.max("Date")).first() == days.agg(F.max("Date")).first()
