"""Mix sources to target weights by repeating documents.

The sizes of each source are summed, targets and from them one repetition rate per
source are derived, and every document is taken floor(rate) times plus once more
with a probability equal to the fraction, drawn from a hash of its id, or of its text where it has none.  No document
depends on another one, so a hot source is an ordinary set of rows.

Defined results: a null text has size 0; a null source is a source of its own that
comes last; rows that repeat an id share its draw, and so do rows without an id that repeat a text;
a source without words has target 0 and none of its documents is taken; an empty
table gives an empty mix.  Columns are picked by name, others pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

# 13 hexadecimal digits fit a double exactly.
_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def known_as(doc_id: Column, text: Column) -> Column:
    """The id of a row as text; of a row without one, a hash of its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def draw(name: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for each name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target, rate`` for rows of ``source, size``.

    Weights go round in code-point order of the sources.  A target stops at ``most``
    times its source's size and the excess is reshared by weight: with sources in
    order of cap per weight, one is full exactly when the level reached by all
    sources before it being full would overfill it too.  The windows see one row
    per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = named.withColumn("weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1).cast("bigint"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        weighed.withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("weight") * F.col("left") >= F.col("cap") * F.col("open"))
    )
    full = F.col("full")
    levelled = capped.withColumn(
        "left_over", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(full, F.col("cap"))).over(everything), F.lit(0))
    ).withColumn(
        "open_over", F.sum("weight").over(everything) - F.coalesce(F.sum(F.when(full, F.col("weight"))).over(everything), F.lit(0))
    )
    target = F.when(full, F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("left_over")).cast("double") / F.col("open_over").cast("double")
    )
    return levelled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def copies(rate: Column, name: Column, seed: int) -> Column:
    whole = F.floor(rate).cast("bigint")
    return whole + F.when(draw(name, seed) < rate - whole, 1).otherwise(0).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), known_as(F.col("doc_id"), F.col("text")).alias("name"))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    Texts are read once; their sizes are written and used for both the sums and the rows.
    """
    sizes = written(sized(docs), "mix-sizes")
    rates = written(source_targets(sizes, weights, most), "mix-rates")
    joined = sizes.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("name"), seed)).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with."""
    rates = written(source_targets(sized(docs), weights, most).select("source", "rate"), "mix-rates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("of"))
    times = copies(F.col("rate"), known_as(F.col("row.doc_id"), F.col("row.text")), seed)
    joined = rows.join(rates, F.col("of").eqNullSafe(F.col("source"))).withColumn("times", times)
    return joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
