"""The star-schema test tables seen as retail data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = {"part": "l_partkey", "supplier": "l_suppkey"}

# Which product category a part type stands for.
PART_CATEGORIES = {
    "ECONOMY": "Physical Good",
    "SMALL": "Subscription Box",
    "STANDARD": "Home & Garden Service",
    "MEDIUM": "Digital",
    "LARGE": "Perishable",
    "PROMO": "Toys & Games",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_transactions(lineitem: DataFrame, grain: str = "supplier") -> DataFrame:
    """Order lines as invoice lines; returned lines are cancelled invoices."""
    flag = F.when(F.col("l_returnflag") == "R", "C").otherwise("")
    return lineitem.select(
        F.concat(flag, F.col("l_orderkey").cast("string")).alias("Invoice"),
        F.col(GRAINS[grain]).cast("string").alias("StockCode"),
        F.col("l_quantity").alias("Quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
        F.col("l_shipdate").alias("InvoiceDate"),
    )


def transactions(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    return as_transactions(table(spark, sf_dir, "lineitem"), grain)


def raw_transactions(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    """The same lines as text, as a CSV would give them, with damage where tax or discount says so."""
    lines = table(spark, sf_dir, "lineitem")
    tax, discount, line = F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return lines.select(
        F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")).alias(
            "Invoice"
        ),
        F.when(line == 7, F.lit(None)).otherwise(F.col(GRAINS[grain]).cast("string")).alias("StockCode"),
        F.when(tax == 0.08, "abc").when(tax == 0.07, "-1").otherwise(F.col("l_quantity").cast("string")).alias(
            "Quantity"
        ),
        F.when(discount == 0.10, "NaN").when(discount == 0.09, "").otherwise(price.cast("string")).alias("Price"),
        F.when(line == 6, "bad").when(line == 5, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(stamp).alias(
            "InvoiceDate"
        ),
    )


def category_of(part_type: Column) -> Column:
    found = F.lit("Other")
    for kind, category in PART_CATEGORIES.items():
        found = F.when(part_type == kind, category).otherwise(found)
    return found


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue templates; figures without a column are set by rule from the key."""
    key = F.col("p_partkey")
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.format_string("P%03d", key).alias("product_id"),
        F.col("p_name").alias("name"),
        category_of(F.col("p_type")).alias("category"),
        price.alias("base_price"),
        (F.lit(-0.5) - (key % 21) / F.lit(10.0)).alias("elasticity"),
        (F.lit(20.0) + key % 181).alias("base_demand"),
        (price * 0.5).alias("price_min"),
        (price * 2.0).alias("price_max"),
        (F.lit(0.05) + (key % 16) / F.lit(100.0)).alias("noise_std"),
        key.alias("template_no"),
    )


def season_parameters(products: DataFrame, number: str = "product_id") -> DataFrame:
    """Season figures per product, by rule from its number."""
    k = F.col(number).cast("bigint")
    return (
        products.withColumn("weekly_amp", F.lit(0.05) + (k % 16) / F.lit(100.0))
        .withColumn("annual_amp", F.lit(0.10) + (k % 31) / F.lit(100.0))
        .withColumn("annual_peak", F.lit(300.0) + k % 61)
        .withColumn("trend_rate", ((k % 6) - 2) / F.lit(10000.0))
    )


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name, a category and a noise level for each supplier-grain product."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(c) for c in PART_CATEGORIES.values()])
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("product_id"),
        F.col("s_name").alias("name"),
        F.element_at(kinds, (k % len(PART_CATEGORIES) + 1).cast("int")).alias("category"),
        (F.lit(0.05) + (k % 16) / F.lit(100.0)).alias("noise_std"),
    )


def described_catalogue(fitted: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted.join(supplier_labels(spark, sf_dir), "product_id")
