"""Connected components of a large graph, by alternating star contractions.

Only edges and per-node minima are shuffled; each round is written to the shared folder, and
the driver sees two numbers a round.  Every node ends up linked with the smallest node it can reach.
Joins on a node with very many edges have one row on the other side and are left to adaptive execution to split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``a, b`` rows; a node without an edge has no row.

    Loops, repeated and reversed edges are the same graph; null ends are left out.
    """
    lower, upper = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = written(edges.where("a <> b").select(upper, lower).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        # Large star: all larger neighbours of a node move to the smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(
            moved.join(least, "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges"
        )
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
