"""Cleaning of raw retail transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import CleanParams
from .positions import code_order

REQUIRED = ("Invoice", "StockCode", "Quantity", "Price", "InvoiceDate")
# What a number looks like; a cast alone would also take letters behind it, as in 5d.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def require_columns(df: DataFrame, columns=REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing transaction columns: {', '.join(missing)}")
    return df


def drop_cancelled(df: DataFrame) -> DataFrame:
    """Cancelled invoices start with an upper-case ``C``; a missing id is kept."""
    require_columns(df, ["Invoice"])
    return df.filter(F.col("Invoice").isNull() | ~F.col("Invoice").startswith("C"))


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Quantity and price as doubles; text that is no number becomes null."""
    require_columns(df, ["Quantity", "Price"])
    for name in ("Quantity", "Price"):
        if not isinstance(df.schema[name].dataType, T.DoubleType):
            text = F.col(name).cast("string")
            df = df.withColumn(name, F.when(text.rlike(NUMBER), text.try_cast("double")))
    return df


def keep_positive(df: DataFrame) -> DataFrame:
    """Drop returns, free lines and NaN, which Spark would rank above every number."""
    keep = F.lit(True)
    for name in ("Quantity", "Price"):
        keep = keep & (F.col(name) > 0) & ~F.isnan(name)
    return df.filter(keep)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Quantity", "Price", "StockCode", "InvoiceDate"])


def parse_time(text: Column, kind: T.DataType, params: CleanParams = CleanParams()) -> Column:
    """A time as a timestamp; null for a text in none of the known spellings.

    A failed format costs an exception per row, so a text only meets the format it looks
    like.  Texts without a year match nothing: they would mean another day on every run.
    """
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return text
    text = F.trim(text)
    time = F.lit(None).cast("timestamp")
    for looks, fmt in reversed(params.time_formats):
        read = F.try_to_timestamp(text, F.lit(fmt)) if fmt else text.try_cast("timestamp")
        time = F.when(text.rlike(looks), read).otherwise(time)
    return time


def parse_invoice_time(df: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """Invoice time as a timestamp; rows whose time cannot be read are dropped."""
    require_columns(df, ["InvoiceDate"])
    time = parse_time(F.col("InvoiceDate"), df.schema["InvoiceDate"].dataType, params)
    return df.withColumn("InvoiceDate", time).filter(F.col("InvoiceDate").isNotNull())


def add_invoice_day(df: DataFrame) -> DataFrame:
    return df.withColumn("Date", F.to_date("InvoiceDate"))


def clean_rows(df: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """All row rules, without the top-k cut: one narrow pass, no shuffle."""
    rows = drop_cancelled(require_columns(df))
    rows = drop_incomplete(keep_positive(coerce_numbers(rows)))
    return add_invoice_day(parse_invoice_time(rows, params))


def top_codes(df: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` codes with most lines; ties go to the first in code order."""
    counts = df.groupBy("StockCode").agg(F.count("Quantity").alias("n_lines"))
    return counts.orderBy(F.col("n_lines").desc(), *code_order("StockCode")).limit(k)


def keep_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines of the listed codes; the list's measured size decides how it is joined."""
    return df.join(codes.select("StockCode"), "StockCode", "left_semi")


def clean_transactions(df: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """Row rules followed by the cut to the most frequent codes."""
    rows = clean_rows(df, params)
    return keep_codes(rows, top_codes(rows, params.top_k))


def rejected_rows(df: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """How many rows each rule drops of those the rules before it kept, and how many stay: one pass, one row."""
    rows = coerce_numbers(require_columns(df))
    positive = (F.col("Quantity") > 0) & (F.col("Price") > 0) & ~F.isnan("Quantity") & ~F.isnan("Price")
    read = parse_time(F.col("InvoiceDate"), df.schema["InvoiceDate"].dataType, params)
    rules = {
        "cancelled": F.coalesce(F.col("Invoice").startswith("C"), F.lit(False)),
        "no_number": F.col("Quantity").isNull() | F.col("Price").isNull(),
        "not_positive": ~positive,
        "no_code": F.col("StockCode").isNull(),
        "no_time": read.isNull(),
    }
    reason = F.lit("kept")
    for name, broken in reversed(rules.items()):
        reason = F.when(broken, name).otherwise(reason)
    named = rows.select(reason.alias("reason"))
    return named.agg(*[F.count_if(F.col("reason") == name).alias(name) for name in (*rules, "kept")])


def clean_report(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("n_rows"), F.countDistinct("StockCode").alias("n_products"))
