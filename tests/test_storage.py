"""Sources and sinks on files."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from pricewright.operators import clean, demand, ledger
from pricewright.params import EpisodeParams
from pricewright.sources import catalogue as S
from pricewright.sources import driver_tables as D
from pricewright.sources import summary, transactions, versions
from pricewright.streaming import daily as stream

HEADER = "InvoiceNo, Stock Code ,Quantity,UnitPrice,InvoiceDate\n"


def test_csv_headers_and_undecodable_bytes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(HEADER.encode() + b"1,caf\xe9 \xff,2,3.5,2023-01-01\n2,b,x,1,2023-01-01\n3,b,1\n")
    df = transactions.read_csv(spark, str(path))
    assert df.columns == ["Invoice", "StockCode", "Quantity", "Price", "InvoiceDate"]
    assert df.count() == 3
    assert [r["Invoice"] for r in clean.clean_rows(df).collect()] == ["1"]


def test_files_with_different_headers(spark, tmp_path):
    """Order, names, further columns, blank files, a packed file, and names that look like patterns."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "1,x,2,3.5,2023-01-01\n")
    (folder / "b [1]{2}.csv").write_text("\ufeffPrice,InvoiceDate,Quantity,Invoice,StockCode,Country\n9.5,2023-01-02,4,2,y,FR\n")
    (folder / "c.csv").write_text("")
    (folder / "d.csv").write_text("Price,InvoiceDate,Quantity,Invoice,StockCode,Country\n")
    with gzip.open(folder / "e f.csv.gz", "wt") as packed:
        packed.write('Quantity,"Stock Code",InvoiceNo,Unitprice,InvoiceDate\n7,z,3,1.25,2023-01-03\n')
    df = transactions.read_csv(spark, str(folder))
    rows = {r["Invoice"]: (r["StockCode"], r["Quantity"], r["Price"], str(r["InvoiceDate"])[:10], r["Country"]) for r in df.collect()}
    assert rows == {"1": ("x", "2", "3.5", "2023-01-01", None), "2": ("y", "4", "9.5", "2023-01-02", "FR"), "3": ("z", "7", "1.25", "2023-01-03", None)}
    assert sorted(len(files) for files in transactions.header_plan(spark, str(folder)).values()) == [1, 1, 2]
    (folder / "g.csv").write_text("InvoiceNo,Quantity,Price,InvoiceDate\n1,2,3,2023-01-01\n")
    with pytest.raises(ValueError, match="g.csv lacks StockCode"):
        transactions.read_csv(spark, str(folder))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        transactions.read_csv(spark, str(tmp_path / "empty.csv"))


def test_colliding_headers_are_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "UnitPrice int, Price int")
    with pytest.raises(ValueError, match="Price"):
        transactions.normalise_headers(df)


def test_first_readable_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "1,a,2,3.5,2023-01-01\n")
    with pytest.warns(UserWarning, match="absent"):
        df = transactions.first_readable(spark, [str(tmp_path / "absent.csv"), str(tmp_path / "b.csv")])
    assert df.count() == 1
    with pytest.warns(UserWarning):
        assert transactions.first_readable(spark, [str(tmp_path / "absent.csv")]) is None


def write_files(folder, ids):
    entries = [{"id": i, "name": f"n{i}", "category": "Toys", "base_price": 2.0, "elasticity": -1.0, "base_demand": 5.0,
                "price_min": 1.0, "price_max": 4.0, "timeseries_file": f"{i}_timeseries.csv"} for i in ids]
    (folder / "products_metadata.json").write_text(json.dumps(entries, indent=2))


def write_series(folder, product):
    (folder / f"{product}_timeseries.csv").write_text(
        "date,day_of_week,day_of_year,price,demand,revenue,seasonal\n2023-01-01,6,1,2.0,5,10.0,1.0\n2023-01-02,0,2,2.0,6,12.0,1.1\n"
    )


def test_catalogue_array_and_series_by_file_name(spark, tmp_path):
    write_files(tmp_path, [20725, "P001"])
    for product in ("20725", "P001"):
        write_series(tmp_path, product)
    products = S.read_catalogue(spark, str(tmp_path / "products_metadata.json"))
    assert {r["product_id"]: r["noise_std"] for r in products.collect()} == {"20725": 0.10, "P001": 0.10}
    series = S.read_series_csv(spark, str(tmp_path))
    joined = S.attach_series(products, series)
    assert joined.count() == 4 and joined.filter("product_id = '20725'").agg({"demand": "sum"}).first()[0] == 11.0


def test_odd_ids_survive_in_file_names(spark, tmp_path):
    for product in ("a b", "50%", "x+y", "caf\u00e9"):
        write_series(tmp_path, product)
    ids = {r["product_id"] for r in S.read_series_csv(spark, str(tmp_path)).select("product_id").collect()}
    assert ids == {"a b", "50%", "x+y", "caf\u00e9"}


def test_series_written_by_file_name_read_again(spark, tmp_path):
    ids = ["a b", "50%", "x+y", "caf\u00e9", "7", "a/b", "file=1"]
    days = [(i, dt.date(2023, 1, 1 + d), d, d + 1, 2.0, 5.0 + d, 10.0, 1.0) for i in ids for d in range(3)]
    series = spark.createDataFrame(days, "product_id string, date date, day_of_week int, day_of_year int, price double, demand double, revenue double, seasonal double")
    S.write_series_csv(series, str(tmp_path / "s"))
    again = S.read_series_csv(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, again.select(series.columns).collect())) == sorted(days)


def test_products_of_plain_names_are_files_of_one_folder(spark, tmp_path):
    ids = ["7", "P001", "b.c", "_d", ".e", "a/b", "x%2Fy", "file=1", "", None]
    days = [(i, dt.date(2023, 1, 3 - d), d, None, 2.5, float("inf"), None, 1e-7) for i in ids for d in range(3)]
    series = spark.createDataFrame(days, "product_id string, date date, day_of_week int, day_of_year int, price double, demand double, revenue double, seasonal double")
    folder = tmp_path / "s"
    S.write_series_csv(series, str(folder))
    names = sorted(p.name for p in folder.iterdir())
    assert [n for n in names if "=" not in n] == ["7_timeseries.csv", "P001_timeseries.csv", "b.c_timeseries.csv"]
    assert (folder / "7_timeseries.csv").read_text().splitlines()[:2] == [",".join(S.SERIES_SCHEMA.names), "2023-01-01,2,,2.5,Infinity,,1.0E-7"]
    again = S.read_series_csv(spark, str(folder)).select(series.columns)
    assert sorted(map(tuple, again.collect()), key=str) == sorted((d for d in days if d[0]), key=str)
    assert [S.find_series_csv(spark, str(folder), i).count() for i in ("7", "_d", "a/b", "x%2Fy", "none")] == [3, 3, 3, 3, 0]
    with pytest.raises(Exception, match="(?i)already exists|exists already"):
        S.write_series_csv(series, str(folder))
    # Spark's writer, which serves storage that is not mounted as files, calls the folders the same.
    series.selectExpr("product_id || '_timeseries.csv' AS file", "price").write.partitionBy("file").csv(str(tmp_path / "t"))
    theirs = {p.name for p in (tmp_path / "t").iterdir()}
    assert {n for n in names if "=" in n} <= theirs


def test_batches_that_end_within_a_product_make_one_file(spark, tmp_path):
    first = dt.date(2023, 1, 1)
    days = [(str(i), first + dt.timedelta(days=d), d, d, 1.0, float(d), 1.0, 1.0) for i in range(9) for d in range(11)]
    series = spark.createDataFrame(days, "product_id string, date date, day_of_week int, day_of_year int, price double, demand double, revenue double, seasonal double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        S.write_series_csv(series.repartition(5), str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == [f"{i}_timeseries.csv" for i in range(9)]
    assert sorted(map(tuple, S.read_series_csv(spark, str(tmp_path / "s")).select(series.columns).collect())) == sorted(days)


def test_series_files_are_opened_once_to_be_attached(spark, tmp_path):
    write_files(tmp_path, ["1"])
    write_series(tmp_path, 1)
    products = S.read_catalogue(spark, str(tmp_path / "products_metadata.json"))
    plan = S.attach_series(products, S.read_series_csv(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert " csv" not in plan and " parquet" in plan


def test_file_per_product_dataset_is_reused(spark, tmp_path):
    write_files(tmp_path, [1, 2])
    for product in (1, 2):
        write_series(tmp_path, product)
    products, series = S.get_products(spark, str(tmp_path), lambda: pytest.fail("built although present"))
    assert products.count() == 2 and series.count() == 4


def test_a_build_that_ends_half_way_changes_nothing(spark, tmp_path):
    """The version before it stays current, whole, and a later build takes its place."""
    path = str(tmp_path / "ds")
    products, series = small_dataset(spark)
    broken = products.withColumn("noise_std", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        S.save_products(broken, series, path)
    assert not S.is_complete(spark, path)
    calls = []

    def build():
        calls.append(1)
        return small_dataset(spark)

    assert S.get_products(spark, path, build)[0].count() == 50 and calls == [1]
    more = series.withColumn("demand", F.lit(9.0))
    with pytest.raises(Exception, match="lost"):
        S.save_products(broken, more, path)
    days = S.load_products(spark, path)[1]
    assert days.agg(F.sum("demand")).first()[0] == 750.0
    assert S.save_products(products, more, path)["number"] == 2
    # A reader that resolved the first version still has it; a new one gets the second.
    assert days.agg(F.sum("demand")).first()[0] == 750.0
    assert S.load_products(spark, path)[1].agg(F.sum("demand")).first()[0] == 1350.0
    assert S.find_series(spark, path, 7).agg(F.sum("demand")).first()[0] == 27.0


def test_versions_are_numbered_and_pruned(spark, tmp_path):
    path = str(tmp_path / "v")

    def write(value):
        def fill(folder):
            spark.range(value).write.parquet(f"{folder}/rows")
            if value == 2:  # another build commits meanwhile
                versions.commit(spark, path, write(7))
            return {"value": value}

        return fill

    assert versions.current(spark, path) is None and versions.prune(spark, path) == 0
    assert [versions.commit(spark, path, write(v))["number"] for v in (1, 2, 3)] == [1, 3, 4]
    assert versions.current(spark, path)["value"] == 3
    assert versions.prune(spark, path, keep=2) == 2
    now = versions.current(spark, path)
    assert now["number"] == 4 and spark.read.parquet(f"{path}/{now['folder']}/rows").count() == 3
    assert len(list((tmp_path / "v" / "versions").iterdir())) == 2


def test_strict_and_lenient_loading(spark, tmp_path):
    write_files(tmp_path, [1, 2])
    write_series(tmp_path, 1)
    products = S.read_catalogue(spark, str(tmp_path / "products_metadata.json"))
    series = S.read_series_csv(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="2"):
        S.attach_series(products, series, strict=True)
    with pytest.warns(UserWarning, match="2"):
        assert {r["product_id"] for r in S.attach_series(products, series, strict=False).collect()} == {"1"}


def small_dataset(spark):
    products = spark.createDataFrame(
        [(str(i), f"n{i}", "Toys", 2.0, -1.0, 5.0, 1.0, 4.0, 0.1) for i in range(50)],
        "product_id string, name string, category string, base_price double, elasticity double, base_demand double, price_min double, price_max double, noise_std double",
    )
    days = [(str(i), dt.date(2023, 1, 1 + d), d, d + 1, 2.0, 5.0, 10.0, 1.0) for i in range(50) for d in range(3)]
    series = spark.createDataFrame(days, "product_id string, date date, day_of_week int, day_of_year int, price double, demand double, revenue double, seasonal double")
    return products, series


def test_saved_products_load_again(spark, tmp_path):
    products, series = small_dataset(spark)
    path = str(tmp_path / "out")
    S.save_products(products, series, path)
    again, days = S.load_products(spark, path)
    assert again.count() == 50 and days.count() == 150
    assert sorted(map(tuple, again.select(*products.columns).collect())) == sorted(map(tuple, products.collect()))
    one = S.find_series(spark, path, 7)
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_lookup_follows_the_stored_number_of_buckets(spark, tmp_path):
    products, series = small_dataset(spark)
    path = str(tmp_path / "many")
    S.save_products(products, series, path, buckets=64)
    assert all(S.find_series(spark, path, i).count() == 3 for i in (0, 7, 23, 49))
    folder = versions.current(spark, path)["folder"]
    files = {r["id"]: r["timeseries_file"] for r in spark.read.json(f"{path}/{folder}/products_metadata.json").collect()}
    assert len(set(files.values())) > 20
    assert spark.read.parquet(files["7"]).filter("product_id = '7'").count() == 3


def test_dataset_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return small_dataset(spark)

    for _ in range(2):
        products, _ = S.get_products(spark, str(tmp_path / "ds"), build)
        assert products.count() == 50
    assert len(calls) == 1


def test_summary_falls_back_to_published_figures(spark, tmp_path):
    path = str(tmp_path / "summary.json")
    fallback = summary.read_summary(spark, path)
    assert {r["source"] for r in fallback.collect()} == {"paper_fallback"} and fallback.count() == 6
    summary.write_summary(spark.createDataFrame([("a", 1.0, 2.0)], summary.SUMMARY_SCHEMA), path)
    own = summary.read_summary(spark, path)
    assert own.schema == fallback.schema and [tuple(r) for r in own.collect()] == [("a", 1.0, 2.0, "trained")]


def test_stream_over_several_files_equals_batch(spark, small_dir, tmp_path):
    """Files in date order, several micro-batches: closed days and ledger equal the batch forms."""
    lines = clean.clean_rows(D.transactions(spark, small_dir)).select("StockCode", "Quantity", "Price", "InvoiceDate")
    source = str(tmp_path / "lines")
    for low, high in (("1995", "1997"), ("1997", "1999"), ("1999", "2003")):
        lines.filter((lines.InvoiceDate >= f"{low}-01-01") & (lines.InvoiceDate < f"{high}-01-01")).coalesce(1).write.mode("append").parquet(source)
    days = stream.daily_demand_stream(stream.read_lines(spark, source, lines.schema, files_per_trigger=1)).drop("day")
    out = {name: str(tmp_path / name) for name in ("days", "days-progress", "ledger", "ledger-progress")}
    stream.run_available(days, out["days"], out["days-progress"])
    closed = spark.read.parquet(out["days"])
    last = lines.agg({"InvoiceDate": "max"}).first()[0].date()
    batch = demand.daily_demand(clean.add_invoice_day(lines)).filter(f"Date <= date '{last}' - 1")

    def keyed(df):
        return {(r["StockCode"], r["Date"]): (round(r["avg_price"], 6), r["total_qty"]) for r in df.collect()}

    assert keyed(closed) == keyed(batch)

    params = EpisodeParams(max_inventory=60, restock=15)
    again = stream.read_lines(spark, out["days"], closed.schema)
    stream.run_available(stream.stock_ledger_stream(again, params), out["ledger"], out["ledger-progress"])
    booked = {(r["StockCode"], r["Date"]): (r["units_sold"], r["lost_units"], r["inventory"], round(r["raw_reward"], 4))
              for r in spark.read.parquet(out["ledger"]).collect()}
    days_in = batch.selectExpr("StockCode", "Date", "total_qty as demand", "avg_price as price")
    expected = {(r["StockCode"], r["Date"]): (r["units_sold"], r["lost_units"], r["inventory"], round(r["raw_reward"], 4))
                for r in ledger.stock_ledger(days_in, ["StockCode"], "Date", params).collect()}
    assert booked == expected


def test_ledger_stream_refuses_days_out_of_order(spark, tmp_path):
    source, out = str(tmp_path / "days"), [str(tmp_path / name) for name in ("ledger", "progress")]
    schema = "StockCode string, Date date, avg_price double, total_qty double"

    def bring(day):
        spark.createDataFrame([("a", dt.date(2023, 1, day), 2.0, 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
        days = stream.read_lines(spark, source, spark.createDataFrame([], schema).schema)
        stream.run_available(stream.stock_ledger_stream(days), *out)

    bring(2)
    bring(3)
    assert spark.read.parquet(out[0]).count() == 2
    with pytest.raises(Exception, match="arrives after"):
        bring(1)


def test_in_date_order(spark, small_dir):
    daily = demand.daily_demand(clean.clean_rows(D.transactions(spark, small_dir)))
    rows = [(r["Date"], r["StockCode"]) for r in demand.in_date_order(daily).collect()]
    assert rows == sorted(rows) and len(rows) > 100
