"""Exact dedup with a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form, which is written once with
the ids; every later pass reads those few bytes and no text.  A frequent-items sketch
(the Misra-Gries family, ``approx_top_k``) names digests that may be frequent.  Their
exact counts are then taken, with one partial row per digest and task, and the verified
winners, at most ``winners`` rows, are broadcast: rows of hot groups get their result
map-side.  All other digests take an ordinary shuffle; they are counted with partial sums, and the join that
brings the count back has one row per digest on its other side, so adaptive execution can split it.  Whatever the
sketch names, each digest takes exactly one of the two ways, so results are exact.

Defined results: a null text counts as empty; the row with the largest id stays, and a
null id is smaller than any other; if all ids of a group are null, ``keep_id`` is null and
all its rows are kept; rows that repeat an id and text share their flag; an empty table
gives an empty result.  Columns are picked by name, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .filters import told_apart

WINNERS = 256
TRACKED = 4096
LEAST = 64


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the hexadecimal digest of the normalised text."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"))


def verified_winners(rows: DataFrame, winners: int = WINNERS, tracked: int = TRACKED, least: int = LEAST) -> DataFrame:
    """``digest, group_size, keep_id`` of the frequent digests, at most ``winners`` rows.

    The sketch may name a rare digest or miss a frequent one; the count is exact, and
    a digest seen fewer than ``least`` times is left to the shuffle.
    """
    named = rows.agg(F.expr(f"approx_top_k(digest, {winners}, {tracked})").alias("top")).select(
        F.explode("top.item").alias("digest")
    )
    return (
        rows.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where(F.col("group_size") >= least)
    )


def groups(docs: DataFrame, winners: int = WINNERS, tracked: int = TRACKED, least: int = LEAST) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return _grouped(written(digests(docs), "exact-digests"), (), winners, tracked, least)


def _grouped(rows: DataFrame, keep: tuple[str, ...], winners: int, tracked: int, least: int) -> DataFrame:
    """The same for rows of ``doc_id, digest`` on storage, and their columns to keep."""
    hot = written(verified_winners(rows, winners, tracked, least), "exact-winners")
    # At most `winners` rows of fixed width.
    of_hot = rows.join(F.broadcast(hot), "digest").select("doc_id", "keep_id", "group_size", "digest", *keep)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    # Combined map-side before the shuffle, so a digest that only just missed the winners sends a row per task to its count.
    counted = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    several = counted.where("group_size > 1")
    joined = rest.join(several, "digest", "left")
    alone = F.col("group_size").isNull()
    of_rest = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        "digest",
        *keep,
    )
    return of_hot.unionByName(of_rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *keep,
    )


def _text() -> Column:
    return lower_ascii(F.coalesce(F.col("text"), F.lit("")))


def _of_row() -> Column:
    """The digest of a row's text as bytes."""
    return F.unhex(F.sha2(_text().cast("binary"), 256))


def _mark() -> Column:
    """A cheap hash of id and text, by which most rows are told from the listed ones."""
    return F.xxhash64("doc_id", _text())


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each text, with the columns it came with.

    Rows are named by id and digest, so an id that is null or has several texts loses only those that are
    copies.  Rows of a group that share the id to keep, null or not, are ``tied``; one of them stays.
    A filter of the listed rows lets nearly all others stay where they lie; only what it may hold meets the
    list in a join.
    """
    rows = written(docs.select("doc_id", F.sha2(_text().cast("binary"), 256).alias("digest"), _mark().alias("mark")), "exact-digests")
    copies = _grouped(rows, ("mark",), WINNERS, TRACKED, LEAST).where("group_size > 1").groupBy("text_sha256", "doc_id", "keep_id", "mark")
    counted = copies.agg(F.count("*").alias("rows"))
    # Without any id in the group, keep_id is null and so are all ids: all rows are tied.
    tied = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named = counted.where(~tied | (F.col("rows") > 1))
    named = written(
        named.select(F.col("doc_id").alias("gone"), F.unhex("text_sha256").alias("gone_text"), tied.alias("gone_tied"), "mark"), "exact-gone"
    )
    single, maybe = told_apart(docs, _mark(), named.select("mark"))
    named = named.drop("mark")
    same = F.col("doc_id").eqNullSafe(F.col("gone")) & (_of_row() == F.col("gone_text"))
    single = single.unionByName(maybe.join(named, same, "left_anti"))
    several = named.where("gone_tied")
    if several.isEmpty():
        return single
    # One partial row per id, digest and task, so a row repeated very often meets no single task.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    left = maybe.join(several, same, "left_semi").select(F.col("doc_id").alias("id"), _of_row().alias("digest"), whole.alias("row"))
    return single.unionByName(left.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
