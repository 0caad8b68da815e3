"""Catalogue listing, lookup, splits, merging and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pricing import iso_date, price_bounds
from .positions import code_order, first_in_order, with_position

# Fixed value: ids of products registered by users start here.
FIRST_CUSTOM_ID = 99000
FITTED_FIELDS = ("base_price", "elasticity", "base_demand", "price_min", "price_max")


def catalogue_listing(products: DataFrame, held_out_id: str) -> DataFrame:
    return products.select(
        F.col("product_id").alias("id"),
        "name",
        "category",
        "base_price",
        "price_min",
        "price_max",
        "elasticity",
        "base_demand",
        (F.col("product_id") == F.lit(str(held_out_id))).alias("is_held_out"),
    )


def find_product(products: DataFrame, product_id) -> DataFrame:
    """Lookup by id; ids are compared as text, so ``7`` and ``"7"`` are the same."""
    return products.filter(F.col("product_id") == F.lit(str(product_id)))


def first_products(products: DataFrame, n: int, code: str = "product_id") -> DataFrame:
    return products.orderBy(*code_order(code)).limit(n)


def split_catalogue(products: DataFrame, n_train: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``n_train`` products as ``train`` and the next one as ``held_out``."""
    order = order or code_order("product_id")
    return first_in_order(products, order, n_train + 1).withColumn(
        "role", F.when(F.col("position") <= n_train, "train").otherwise("held_out")
    )


def series_extract(series: DataFrame, product_id, days: int = 365) -> DataFrame:
    one = series.filter(F.col("product_id") == F.lit(str(product_id)))
    return first_days(one, days).select(
        iso_date(F.col("date")).alias("date"), "price", "demand", "revenue", "seasonal"
    )


def first_days(series: DataFrame, days: int = 365) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy("date"))
    return series.withColumn("_day", rank).filter(F.col("_day") <= days).drop("_day")


def with_series(products: DataFrame, series: DataFrame) -> DataFrame:
    """Catalogue columns on every series row.

    No broadcast hint: the catalogue grows with the data, so its measured size
    decides between a broadcast and a shuffled join.
    """
    return series.join(products, "product_id")


def overlay_fitted(templates: DataFrame, fitted: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Give the i-th template the values of the i-th fitted product in code order.

    Templates without a partner stay as they are; fitted products without one are
    dropped.  Other template fields are kept.
    """
    left = with_position(templates, order or code_order("product_id"))
    right = with_position(fitted, code_order("product_id")).select(
        "position",
        F.col("product_id").alias("_f_product_id"),
        *[F.col(c).alias(f"_f_{c}") for c in FITTED_FIELDS],
    )
    replaced = {"product_id", *FITTED_FIELDS}
    columns = [
        F.coalesce(F.col(f"_f_{c}"), F.col(c)).alias(c) if c in replaced else F.col(c)
        for c in templates.columns
    ]
    return left.join(right, "position", "left").select("position", *columns)


def add_custom_products(products: DataFrame, custom: DataFrame) -> DataFrame:
    """Append one-row-per-product ``custom`` data under the next free custom ids.

    ``custom`` needs ``name, category, base_price, base_demand, elasticity`` and an
    integer ``request_no`` counting from 0, which fixes the order of the new ids.
    Price bounds of custom products are not rounded.
    """
    taken = products.select(F.col("product_id").try_cast("bigint").alias("n")).agg(
        F.count_if(F.col("n") >= FIRST_CUSTOM_ID).alias("_taken")
    )
    low, high = price_bounds(F.col("base_price"), digits=None)
    fresh = custom.select(
        (F.lit(FIRST_CUSTOM_ID) + taken.scalar() + F.col("request_no")).cast("string").alias("product_id"),
        "name",
        "category",
        "base_price",
        "elasticity",
        "base_demand",
        low.alias("price_min"),
        high.alias("price_max"),
        F.lit(0.10).alias("noise_std"),
        F.lit(True).alias("is_custom"),
    )
    return products.unionByName(fresh, allowMissingColumns=True)
