"""Rows that a list names, told apart without a shuffle of the others.

The list's 64-bit marks fill a blocked Bloom filter of built-in functions: a mark sets one bit in each of the eight words of a
block, about sixteen bits a mark, so about one row in a thousand passes by mistake.  The filter is sized by the list;
a list beyond ``PART`` marks is cut by a hash of the mark into parts with a filter each, so no task ever holds more than one of 8 MB,
and rows are read once for each part.  What passes is for an exact join to decide; what does not pass is not listed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of a block
BITS = 16  # a mark
PART = 4_000_000  # marks


def _bits(mark: Column) -> list[Column]:
    """The bit that a mark sets in each word of its block."""
    spread = F.xxhash64(mark, F.lit(17))
    return [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def _block(mark: Column, blocks: int) -> Column:
    return F.pmod(mark, F.lit(blocks)).cast("int")


def filled(marks: DataFrame, blocks: int) -> Column:
    """The words of a filter that holds the column ``mark``, as one array."""
    one = F.lit(1).cast("bigint")
    words = [F.bit_or(F.call_function("shiftleft", one, bit)).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("mark")))]
    held = marks.groupBy(_block(F.col("mark"), blocks).alias("block")).agg(*words)
    every = marks.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(held, "block", "left")
    row = F.struct("block", F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("bigint")) for i in range(WORDS)]).alias("words"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["words"]))).scalar()


def _passes(words: Column, mark: Column, blocks: int) -> Column:
    """Whether all bits of a mark are set among the words of a filter."""
    first = _block(mark, blocks) * WORDS
    tests = [F.call_function("shiftrightunsigned", F.get(words, first + i), bit).bitwiseAND(F.lit(1)) == 1 for i, bit in enumerate(_bits(mark))]
    return reduce(lambda a, b: a & b, tests)


def told_apart(rows: DataFrame, mark: Column, listed: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``mark`` is certainly not in ``listed`` (its column ``mark``, without nulls), and all others.

    ``listed`` is read several times and should lie on storage; ``mark`` is a bigint and never null.
    """
    n = listed.count()
    if not n:
        return rows, rows.limit(0)
    parts = -(-n // part)
    blocks = max(64, -(-n * BITS // (parts * WORDS * 64)))
    # As a generated column the mark is worked out once a row; a plain one would be put into each of the tests below.
    name = f"mark-{uuid.uuid4().hex}"
    marked, own_mark = rows.select("*", F.explode(F.array(mark)).alias(name)), F.col(f"`{name}`")
    clean, hits = [], []
    for i in range(parts):
        own = listed.where(F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(parts)) == i) if parts > 1 else listed
        here = marked.where(F.pmod(F.xxhash64(own_mark, F.lit(5)), F.lit(parts)) == i) if parts > 1 else marked
        passes = _passes(filled(own, blocks), own_mark, blocks)
        clean.append(here.where(~passes).drop(name))
        hits.append(here.where(passes).drop(name))
    return tuple(reduce(lambda a, b: a.unionByName(b), frames) for frames in (clean, hits))
