"""Registered queries: what was written to the shared folder reads back the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators import evaluate as E
from ..session import fresh_path
from ..sources import catalogue as S
from ..sources import driver_tables as D
from ..sources import summary, transactions
from . import base as B
from .policies import totals_of
from .registry import query
from .sql import rnd

SERIES = f"""product_id, date, day_of_week, day_of_year, {rnd('price')} AS price, {rnd('demand')} AS demand,
    {rnd('revenue', 4)} AS revenue, {rnd('seasonal')} AS seasonal"""


@query(
    "S1, S3, S4",
    f"""SELECT "Invoice", "StockCode", {rnd('"Quantity"')} AS "Quantity", {rnd('"Price"')} AS "Price", "Date"
        FROM raw_clean""",
)
def transactions_from_csv(spark, sf_dir):
    """Files of two shops: other names, another order of the columns."""
    path = fresh_path(spark, "csv")
    raw = D.raw_transactions(spark, sf_dir)
    first = F.pmod(F.xxhash64(*raw.columns), F.lit(2)) == 0
    untidy = ["InvoiceNo", " Stock Code", "Quantity ", "Unit Price", "InvoiceDate"]
    raw.filter(first).toDF(*untidy).write.option("header", True).csv(f"{path}/one")
    other = raw.filter(~first).select("Price", "InvoiceDate", "StockCode", "Invoice", "Quantity")
    other.write.option("header", True).csv(f"{path}/other")
    rows = clean.clean_rows(transactions.read_csv(spark, [f"{path}/one", f"{path}/other"]))
    return B.rounded(rows.select("Invoice", "StockCode", "Quantity", "Price", "Date"))


@query(
    "S2",
    f"""SELECT "Invoice", "StockCode", {rnd('"Quantity"')} AS "Quantity", {rnd('"Price"')} AS "Price" FROM lines_supplier""",
)
def first_readable_source(spark, sf_dir):
    path = fresh_path(spark, "lines")
    D.transactions(spark, sf_dir).write.parquet(path)
    found = transactions.first_readable(spark, [f"{path}-absent", path], transactions.read_parquet)
    return B.rounded(found.select("Invoice", "StockCode", "Quantity", "Price"))


@query(
    "S5, S6",
    f"""SELECT s.product_id, date, day_of_week, day_of_year, {rnd('s.price')} AS price, {rnd('demand')} AS demand,
        {rnd('revenue', 4)} AS revenue, {rnd('seasonal')} AS seasonal, name, base_price
        FROM series s JOIN described d ON s.product_id = d.product_id""",
)
def catalogue_and_series_files(spark, sf_dir):
    """A catalogue file beside one series per product, each found by its file name."""
    path = fresh_path(spark, "files")
    B.catalogue(spark, sf_dir).withColumnRenamed("product_id", "id").write.json(f"{path}/catalogue")
    S.write_series_csv(B.series(spark, sf_dir), f"{path}/series")
    products = S.read_catalogue(spark, f"{path}/catalogue", multi_line=False)
    joined = S.attach_series(products, S.read_series_csv(spark, f"{path}/series"))
    return B.rounded(
        joined.select("product_id", *S.SERIES_SCHEMA.names, "name", "base_price"), revenue=4, base_price=None
    )


@query("S7", f"SELECT {SERIES} FROM series JOIN (SELECT product_id AS id FROM described) ON id = product_id")
def saved_product_series(spark, sf_dir):
    path = fresh_path(spark, "products")
    S.save_products(B.catalogue(spark, sf_dir), B.series(spark, sf_dir), path)
    _, series = S.load_products(spark, path, strict=False)
    return B.rounded(series.select("product_id", *S.SERIES_SCHEMA.names), revenue=4)


@query("S10", "SELECT product_id, name, category, base_price, elasticity FROM described")
def built_or_reused_catalogue(spark, sf_dir):
    path = fresh_path(spark, "dataset")

    def build():
        return B.catalogue(spark, sf_dir), B.series(spark, sf_dir)

    S.get_products(spark, path, build)
    catalogue, _ = S.get_products(spark, path, lambda: (_ for _ in ()).throw(AssertionError("built twice")))
    return catalogue.select("product_id", "name", "category", "base_price", "elasticity")


@query(
    "S8, S9",
    f"""SELECT policy, {rnd('avg(mean_reward)')} AS mean_reward, {rnd('avg(std_reward)')} AS std_reward,
        'trained' AS source FROM evaluation GROUP BY policy""",
)
def saved_policy_summary(spark, sf_dir):
    path = f"{fresh_path(spark, 'summary')}/summary.json"
    totals = totals_of(spark, sf_dir)
    summary.write_summary(E.summarise_policies(E.evaluate_policies(totals)), path)
    return B.rounded(summary.read_summary(spark, path))
