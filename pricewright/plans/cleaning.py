"""Registered queries: cleaning and daily demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import clean, demand, incremental, sketches
from ..params import CleanParams
from ..session import fresh_path, write_once
from ..sources import driver_tables as D
from . import base as B
from .registry import cte, query
from .sql import code_order, fit_ctes, rnd

cte(
    "raw_lines",
    """
    SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS "Invoice",
           CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS "StockCode",
           CASE WHEN l_tax = 0.08e0 THEN 'abc' WHEN l_tax = 0.07e0 THEN '-1'
                ELSE CAST(l_quantity AS VARCHAR) END AS "Quantity",
           CASE WHEN l_discount = 0.1e0 THEN 'NaN' WHEN l_discount = 0.09e0 THEN ''
                ELSE CAST(l_extendedprice / l_quantity AS VARCHAR) END AS "Price",
           CASE WHEN l_linenumber = 6 THEN 'bad' WHEN l_linenumber = 5 THEN strftime(l_shipdate, '%Y-%m-%d')
                ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS "InvoiceDate"
    FROM lineitem""",
)
cte(
    "raw_coerced",
    """
    SELECT "Invoice", "StockCode", TRY_CAST("Quantity" AS DOUBLE) AS "Quantity",
           TRY_CAST("Price" AS DOUBLE) AS "Price", "InvoiceDate" FROM raw_lines""",
)
cte(
    "raw_clean",
    """
    SELECT "Invoice", "StockCode", "Quantity", "Price", TRY_CAST("InvoiceDate" AS TIMESTAMP) AS "InvoiceDate",
           CAST(TRY_CAST("InvoiceDate" AS TIMESTAMP) AS DATE) AS "Date"
    FROM raw_coerced
    WHERE NOT starts_with("Invoice", 'C') AND "Quantity" > 0 AND "Price" > 0
      AND NOT isnan("Quantity") AND NOT isnan("Price") AND "StockCode" IS NOT NULL
      AND TRY_CAST("InvoiceDate" AS TIMESTAMP) IS NOT NULL""",
)
cte(
    "top_raw",
    f"""
    SELECT "StockCode", count("Quantity") AS n_lines FROM raw_clean GROUP BY "StockCode"
    ORDER BY n_lines DESC, {code_order('"StockCode"')} LIMIT 20""",
)
# The lines of the most frequent products among those, fitted.
cte("clean_raw", 'SELECT * FROM raw_clean WHERE "StockCode" IN (SELECT "StockCode" FROM top_raw)')
fit_ctes("raw")
RAW_COLUMNS = f'"Invoice", "StockCode", {rnd(chr(34) + "Quantity" + chr(34))} AS "Quantity", ' + (
    f'{rnd(chr(34) + "Price" + chr(34))} AS "Price"'
)


@query("F1", 'SELECT * FROM raw_lines WHERE NOT starts_with("Invoice", \'C\')')
def drop_cancelled_invoices(spark, sf_dir):
    return clean.drop_cancelled(D.raw_transactions(spark, sf_dir))


@query(
    "F2",
    f"""SELECT "Invoice", "StockCode", {rnd('CASE WHEN isnan("Quantity") THEN -1e0 ELSE "Quantity" END')} AS "Quantity",
        {rnd('CASE WHEN isnan("Price") THEN -1e0 ELSE "Price" END')} AS "Price", "InvoiceDate" FROM raw_coerced""",
)
def coerce_quantity_and_price(spark, sf_dir):
    rows = clean.coerce_numbers(D.raw_transactions(spark, sf_dir))
    # NaN is shown as -1 here, only so that it can be compared
    for name in ("Quantity", "Price"):
        rows = rows.withColumn(name, F.when(F.isnan(name), F.lit(-1.0)).otherwise(F.col(name)))
    return B.rounded(rows)


@query(
    "F3",
    f"""SELECT {RAW_COLUMNS}, "InvoiceDate" FROM raw_coerced
        WHERE "Quantity" > 0 AND "Price" > 0 AND NOT isnan("Quantity") AND NOT isnan("Price")""",
)
def keep_positive_lines(spark, sf_dir):
    return B.rounded(clean.keep_positive(clean.coerce_numbers(D.raw_transactions(spark, sf_dir))))


@query(
    "F4",
    """SELECT "Invoice", "StockCode", "InvoiceDate" FROM raw_coerced
       WHERE "Quantity" IS NOT NULL AND "Price" IS NOT NULL AND NOT isnan("Quantity") AND NOT isnan("Price")
         AND "StockCode" IS NOT NULL AND "InvoiceDate" IS NOT NULL""",
)
def drop_incomplete_lines(spark, sf_dir):
    rows = clean.drop_incomplete(clean.coerce_numbers(D.raw_transactions(spark, sf_dir)))
    return rows.select("Invoice", "StockCode", "InvoiceDate")


@query(
    "F5",
    """SELECT "Invoice", "StockCode", strftime(TRY_CAST("InvoiceDate" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS invoice_time
       FROM raw_lines WHERE TRY_CAST("InvoiceDate" AS TIMESTAMP) IS NOT NULL""",
)
def parse_invoice_times(spark, sf_dir):
    rows = clean.parse_invoice_time(D.raw_transactions(spark, sf_dir))
    return rows.select("Invoice", "StockCode", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("invoice_time"))


@query(
    "F6",
    """SELECT "Invoice", "StockCode", CAST(TRY_CAST("InvoiceDate" AS TIMESTAMP) AS DATE) AS "Date"
       FROM raw_lines WHERE TRY_CAST("InvoiceDate" AS TIMESTAMP) IS NOT NULL""",
)
def invoice_days(spark, sf_dir):
    rows = clean.add_invoice_day(clean.parse_invoice_time(D.raw_transactions(spark, sf_dir)))
    return rows.select("Invoice", "StockCode", "Date")


@query(
    "F7",
    f"""SELECT {RAW_COLUMNS}, "Date" FROM raw_clean
        WHERE "StockCode" IN (SELECT "StockCode" FROM top_raw)""",
)
def clean_transaction_table(spark, sf_dir):
    rows = clean.clean_transactions(D.raw_transactions(spark, sf_dir))
    return B.rounded(rows.select("Invoice", "StockCode", "Quantity", "Price", "Date"))


@query(
    "F8",
    """SELECT count(*) AS n_rows, count(DISTINCT "StockCode") AS n_products FROM raw_clean
       WHERE "StockCode" IN (SELECT "StockCode" FROM top_raw)""",
)
def clean_table_report(spark, sf_dir):
    return clean.clean_report(clean.clean_transactions(D.raw_transactions(spark, sf_dir)))


@query(
    "F8",
    """SELECT count(*) FILTER (why = 'cancelled') AS cancelled, count(*) FILTER (why = 'no_number') AS no_number,
       count(*) FILTER (why = 'not_positive') AS not_positive, count(*) FILTER (why = 'no_code') AS no_code,
       count(*) FILTER (why = 'no_time') AS no_time, count(*) FILTER (why = 'kept') AS kept
       FROM (SELECT CASE WHEN starts_with("Invoice", 'C') THEN 'cancelled'
                         WHEN "Quantity" IS NULL OR "Price" IS NULL THEN 'no_number'
                         WHEN NOT ("Quantity" > 0 AND "Price" > 0) OR isnan("Quantity") OR isnan("Price") THEN 'not_positive'
                         WHEN "StockCode" IS NULL THEN 'no_code'
                         WHEN TRY_CAST("InvoiceDate" AS TIMESTAMP) IS NULL THEN 'no_time' ELSE 'kept' END AS why
             FROM raw_coerced)""",
)
def rejected_rows(spark, sf_dir):
    """How many lines each rule drops, and how many stay."""
    return clean.rejected_rows(D.raw_transactions(spark, sf_dir))


@query(
    "T1",
    f"""SELECT "StockCode", count("Quantity") AS n_lines FROM clean_part GROUP BY "StockCode"
        ORDER BY n_lines DESC, {code_order('"StockCode"')} LIMIT 20""",
)
def top_product_codes(spark, sf_dir):
    return clean.top_codes(B.cleaned(spark, sf_dir, "part"), CleanParams().top_k)


@query(
    "T1",
    f"""SELECT "StockCode", count("Quantity") AS n_lines FROM clean_part GROUP BY "StockCode"
        ORDER BY n_lines DESC, {code_order('"StockCode"')} LIMIT 20""",
)
def top_codes_from_sketches(spark, sf_dir):
    """The same from daily sketches on storage; exact counts of their candidates decide."""
    lines = B.cleaned(spark, sf_dir, "part")
    stored = write_once(sketches.daily_sketches(lines), "daily-sketches")
    return sketches.top_codes_of_days(stored, lines, CleanParams().top_k)


@query(
    "J1",
    f"""SELECT "Invoice", "StockCode", {rnd('"Quantity"')} AS "Quantity", {rnd('"Price"')} AS "Price", "Date"
        FROM clean_part WHERE "StockCode" IN (
            SELECT "StockCode" FROM clean_part GROUP BY "StockCode"
            ORDER BY count("Quantity") DESC, {code_order('"StockCode"')} LIMIT 20)""",
)
def lines_of_top_products(spark, sf_dir):
    rows = B.cleaned(spark, sf_dir, "part")
    kept = clean.keep_codes(rows, clean.top_codes(rows, 20))
    return B.rounded(kept.select("Invoice", "StockCode", "Quantity", "Price", "Date"))


DAILY = f'"StockCode", "Date", {rnd("avg_price")} AS avg_price, {rnd("total_qty")} AS total_qty'


@query("A1", f"SELECT {DAILY} FROM daily_part")
def daily_product_demand(spark, sf_dir):
    return B.rounded(B.daily(spark, sf_dir, "part"))


@query("A2", f"SELECT {DAILY} FROM dense_part")
def products_with_enough_days(spark, sf_dir):
    return B.rounded(demand.keep_dense_products(B.daily(spark, sf_dir, "part"), 30))


@query(
    "A3",
    f"""SELECT "StockCode", {rnd('avg(avg_price)')} AS base_price, {rnd('avg(total_qty)')} AS base_demand,
        count(*) AS n_days FROM dense_part GROUP BY "StockCode" """,
)
def base_price_and_demand(spark, sf_dir):
    dense = demand.keep_dense_products(B.daily(spark, sf_dir, "part"), 30)
    return B.rounded(demand.product_levels(dense))


@query("A4", f"SELECT {DAILY} FROM points_supplier WHERE inside")
def demand_without_outliers(spark, sf_dir):
    dense = demand.keep_dense_products(B.daily(spark, sf_dir), 30)
    return B.rounded(demand.without_outliers(dense))


@query(
    "A5",
    f"""SELECT "StockCode", {rnd('elasticity')} AS elasticity, {rnd('base_price')} AS base_price,
        {rnd('base_demand')} AS base_demand, n_points,
        n_points >= 10 AND (flat < -5e0 OR flat > -0.1e0) AS clipped FROM fits_part""",
)
def price_elasticity(spark, sf_dir):
    dense = demand.keep_dense_products(B.daily(spark, sf_dir, "part"), 30)
    return B.rounded(demand.fit_elasticity(dense))


@query(
    "A2, A3, A5",
    f"""SELECT "StockCode", {rnd('elasticity')} AS elasticity, {rnd('base_price')} AS base_price,
        {rnd('base_demand')} AS base_demand, n_points,
        n_points >= 10 AND (flat < -5e0 OR flat > -0.1e0) AS clipped FROM fits_supplier""",
)
def incremental_price_elasticity(spark, sf_dir):
    """The same fit for suppliers, brought up to date three times as years of days come in."""
    path = fresh_path(spark, "fit-state")
    days = write_once(B.daily(spark, sf_dir), "daily")
    year = F.year("Date")
    low, high = days.agg(F.min(year), F.max(year)).first()
    cuts = [low + (high - low + 1) * i // 3 for i in range(4)]
    for begin, end in zip(cuts, cuts[1:]):
        incremental.update_fits(days.filter((year >= begin) & (year < end)), path)
    return B.rounded(incremental.current_fits(spark, path))


@query("A6", "SELECT * FROM fitted_part")
def fitted_product_catalogue(spark, sf_dir):
    return B.fitted(spark, sf_dir, "part")


@query("T3", f"SELECT {DAILY} FROM daily_supplier")
def daily_demand_in_date_order(spark, sf_dir):
    return B.rounded(demand.in_date_order(B.daily(spark, sf_dir)))


@query(
    "T5",
    f"""SELECT * FROM fitted_supplier ORDER BY {code_order('product_id')} LIMIT 6""",
)
def first_products_in_code_order(spark, sf_dir):
    return C.first_products(B.fitted(spark, sf_dir), 6)
