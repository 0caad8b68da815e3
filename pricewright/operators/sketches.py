"""Top codes and numbers of codes from stored sketches, one a day.

A day's lines are read once, into two small sketches; any span of days is answered by merging theirs.  The frequent-items sketch
only names candidates: their exact counts decide, and where its error bound leaves a doubt all codes are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import top_codes
from .positions import code_order

TRACKED = 4096  # codes that a sketch keeps at most
# Fixed by the sketch: a count is off by at most this over the tracked number, as a share of all lines.
ERROR = 3.5


def daily_sketches(lines: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``Date, n_lines, codes, distinct``: a row per day."""
    return lines.groupBy("Date").agg(
        F.count("Quantity").alias("n_lines"),
        F.expr(f"approx_top_k_accumulate(StockCode, {tracked})").alias("codes"),
        F.hll_sketch_agg("StockCode").alias("distinct"),
    )


def distinct_codes(sketches: DataFrame) -> DataFrame:
    """``n_lines, n_products`` of the days in ``sketches``; the number of products is an estimate."""
    return sketches.agg(F.sum("n_lines").alias("n_lines"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_products"))


def top_codes_of_days(sketches: DataFrame, lines: DataFrame, k: int = 20, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``top_codes`` for the lines behind the sketches.

    ``lines`` are those of the same days.  Only lines of candidates are counted, unless a code that is no candidate might
    still belong among the first ``k``: then all are.
    """
    # Grouped by a constant, since the sketch cannot be made of no rows at all.
    merged = sketches.groupBy(F.lit(1).alias("all")).agg(F.sum("n_lines").alias("n"), F.expr(f"approx_top_k_combine(codes, {tracked})").alias("codes"))
    named = merged.select("n", F.explode(F.expr(f"approx_top_k_estimate(codes, {tracked})")).alias("c")).select("n", "c.item", "c.count")
    # At most ``tracked`` rows.
    found = named.collect()
    if len(found) < k:
        return top_codes(lines, k)
    off = ERROR * found[0]["n"] / tracked
    estimated = sorted((r["count"] for r in found), reverse=True)
    least = estimated[k - 1] - off  # what the k-th code has at least
    candidates = [r["item"] for r in found if r["count"] + off >= least]
    if len(found) >= 0.75 * tracked and off >= least:  # a code the sketch has let go may have that many
        return top_codes(lines, k)
    chosen = lines.sparkSession.createDataFrame([(c,) for c in candidates], "StockCode string")
    counts = lines.join(F.broadcast(chosen), "StockCode", "left_semi").groupBy("StockCode").agg(F.count("Quantity").alias("n_lines"))
    return counts.orderBy(F.col("n_lines").desc(), *code_order("StockCode")).limit(k)
