"""The whole dataset: from text files of transactions to a committed catalogue with a series for every product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand
from ..operators.calendar import expected_series
from ..operators.catalogue import FITTED_FIELDS, overlay_fitted
from ..operators.clean import clean_transactions
from ..params import CleanParams, FitParams
from ..session import write_once
from .catalogue import SERIES_SCHEMA, load_products, save_products
from .transactions import read_csv

# First day and length of the series of products that have no log.
FIRST_DAY = "2020-01-01"
N_DAYS = 1095


def dataset_parts(
    transactions: DataFrame,
    templates: DataFrame,
    order: list[Column],
    first_day: str = FIRST_DAY,
    n_days: int = N_DAYS,
    clean: CleanParams = CleanParams(),
    fit: FitParams = FitParams(),
) -> tuple[DataFrame, DataFrame, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]:
    """Catalogue, series of the logged products, and the other products with what makes their series.

    The most frequent products of the cleaned transactions are fitted and take the place of the first templates, one by
    one; their series are their logged days.  Every other template keeps its figures and gets the series its
    season figures (``weekly_amp, annual_amp, annual_peak, trend_rate``) lead one to expect over ``n_days``.
    """
    daily = demand.daily_demand(clean_transactions(transactions, clean))
    priced = write_once(demand.priced_series(daily, fit), "priced-days")
    # The figures are the same on all days of a product.
    fitted = priced.groupBy("product_id").agg(*[F.min(c).alias(c) for c in FITTED_FIELDS])
    catalogue = write_once(overlay_fitted(templates, fitted, order), "catalogue")
    logged = priced.select("product_id").distinct()
    known = priced.join(catalogue.select("product_id"), "product_id", "left_semi")
    unlogged = catalogue.join(logged, "product_id", "left_anti").withColumn("start_date", F.lit(first_day).cast("date"))
    columns = ["product_id", *SERIES_SCHEMA.names]

    def expected(products: DataFrame) -> DataFrame:
        return expected_series(products, "start_date", n_days).select(columns)

    return catalogue, known.select(columns), (unlogged, expected)


def build_dataset(transactions: DataFrame, templates: DataFrame, order: list[Column], **options) -> tuple[DataFrame, DataFrame]:
    """Catalogue and series of all products; the options are those of ``dataset_parts``."""
    catalogue, logged, (unlogged, expected) = dataset_parts(transactions, templates, order, **options)
    return catalogue, logged.unionByName(expected(unlogged))


def dataset_from_csv(
    spark: SparkSession, paths: str | list[str], templates: DataFrame, order: list[Column], directory: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Read transactions, build and commit the dataset in ``directory``, and load it again."""
    catalogue, logged, unlogged = dataset_parts(read_csv(spark, paths), templates, order, **options)
    save_products(catalogue, logged, directory, unfolded=unlogged)
    return load_products(spark, directory)
