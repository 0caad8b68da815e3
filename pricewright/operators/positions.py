"""Orders and positions that never put a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

# monotonically_increasing_id keeps the row number inside a partition in the low 33 bits.
_ROW_BITS = (1 << 33) - 1


def code_order(code: str) -> list[Column]:
    """Sort keys for product codes: numbers first and by value, then the other codes."""
    number = F.col(code).try_cast("bigint")
    return [number.isNull().asc(), number.asc(), F.col(code).asc()]


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in a total order.

    A window without partition would sort the table in one task.  Here the rows
    are range-partitioned and sorted in place, written once to the shared folder
    (so that the partition numbers cannot change between the two uses), and each
    partition is shifted by the size of those before it.  Only one row per
    partition is ever gathered.
    """
    laid_out = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        laid_out.groupBy("_slice")
        .agg(F.count("*").alias("_size"))
        .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition: its size is bounded by the partition count.
    return laid_out.join(F.broadcast(shifts), "_slice").select(
        *df.columns, (F.col("_before") + F.col("_row") + 1).alias(name)
    )


def first_in_order(df: DataFrame, order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first ``n`` rows of a total order with their 1-based position.

    ``orderBy().limit()`` is a distributed top-n; the window sees ``n`` rows.
    """
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
