"""Prefix trie of conversations by whole-sequence collapse.

A turn is known by the digest of its role and text, and a prefix by its depth and two 64-bit xors of hashes of
(depth, digest), so no text is shuffled and no conversation is gathered: positions, prefixes and sums along a
conversation are running totals over range partitions (``scans``), and a conversation of a third of all turns is dealt
over many tasks.  Identical conversations collapse into one weighted sequence that keeps its smallest member;
its ends, the members' ids, are written as chunks in order and hashed as a stream.  Sequences that are
proper prefixes of another one are found by a join on the prefix; those the anti-join leaves are the leaves.  The weighted
prefixes of the sequences are then aggregated into nodes, with map-side partial sums.  For sums over a subtree each node
is counted on one path alone, that of its smallest member: what a sequence has from a depth on is a running
total, and a node adds up the sequences that pass it.

Defined results: rows without conv_id belong to no conversation and are left out; null role or text is empty; null turns
come first; rows that share a turn follow the order of the MD5 of role and text, and repeated rows are turns of their own;
the root counts every conversation, also one that has no turn after it is rebuilt; an empty table gives no
node.  Columns are picked by name, so others cannot clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, written
from .mixing import word_count
from .scans import running

_KEY = ["d", "k1", "k2"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words`` of every turn, positions from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        digest.alias("digest"),
        word_count(text).alias("words"),
        # Rows that are equal in all else are interchangeable; this only deals them over partitions.
        F.monotonically_increasing_id().alias("row"),
        F.lit(1).cast("bigint").alias("one"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    return running(rows, "conv_id", order, {"pos": ("sum", "one")}, "turns").select("conv_id", "pos", "digest", "words")


def head_length(conv_id: Column, most: int) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def rebuilt(turned: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations after their heads are exchanged: ``conv_id, n`` of each, and ``conv_id, d, digest, words`` of its turns.

    The first h turns, h below ``most`` by a hash of the id, are those of the conversation whose id is
    the next lower multiple of ``family``.  A conversation gets at most ``most - 1`` rows from another one.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    sizes = written(
        turned.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("of", first).withColumn("h", head_length(F.col("conv_id"), most)),
        "conversation-sizes",
    )
    of = sizes.where(F.col("conv_id") == F.col("of")).select("of", F.col("own").alias("there"))
    lent = F.least(F.col("h"), F.coalesce(F.col("there"), F.lit(0)))
    known = sizes.join(of, "of", "left").withColumn("lent", lent)
    known = written(known.withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turned.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "of")
    borrowed = known.select("conv_id", "of", "h").join(heads, "of").where("pos <= h").select("conv_id", F.col("pos").alias("d"), "digest", "words")
    kept = turned.join(known.select("conv_id", "h", "lent"), "conv_id").where("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("d"), "digest", "words")
    return known.select("conv_id", "n"), kept.unionByName(borrowed)


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, d, k1, k2, p1, p2, words``: each turn with the key of the prefix it ends and of the one before it."""
    hashed = rows.withColumn("z1", F.xxhash64(F.lit(1), "d", "digest")).withColumn("z2", F.xxhash64(F.lit(2), "digest", "d"))
    order = [F.col("conv_id").asc(), F.col("d").asc()]
    keyed = running(hashed.drop("digest"), "conv_id", order, {"k1": ("xor", "z1"), "k2": ("xor", "z2")}, "prefixes")
    return keyed.select(
        "conv_id", *_KEY, F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "words"
    )


def end_digests(wholes: DataFrame) -> DataFrame:
    """``d, k1, k2, ends_sha256`` for rows of ``conv_id, d, k1, k2``: the hash of the ids that share a key, in order.

    Ids are joined into chunks where a range partition has them, so a very large group costs the task that hashes it a
    few rows; chunks go through the hash as a stream.
    """
    names = [*_KEY, "first", "ids"]

    def join(batches):
        for batch in batches:
            found, at = [], None
            for *key, conv_id in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "conv_id")]):
                if key != at:
                    found.append((*key, conv_id, []))
                    at = key
                found[-1][-1].append(str(conv_id))
            if found:
                columns = list(zip(*[(*f[:-1], ",".join(f[-1])) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names)

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
                if key == at:
                    state.update(b",")
                else:
                    out += [(*at, state.hexdigest())] if at else []
                    at, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], o)) for o in out])
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], (*at, state.hexdigest())))])

    key_types = "d bigint, k1 bigint, k2 bigint"
    chunks = (
        wholes.select(*_KEY, "conv_id")
        .repartitionByRange(*_KEY, "conv_id")
        .sortWithinPartitions(*_KEY, "conv_id")
        .mapInArrow(join, f"{key_types}, first bigint, ids string")
    )
    dealt = chunks.repartition(parts(wholes.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(hashed, f"{key_types}, ends_sha256 string")


def sequences(known: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The key of each whole conversation (``conv_id, d, k1, k2``), and one row of ``d, k1, k2, weight, conv_id`` per distinct one."""
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "d").alias("k"))
    whole = known.join(last, "conv_id", "left").select(
        "conv_id", F.col("n").alias("d"), *[F.coalesce(F.col(f"k.{c}"), F.lit(0).cast("bigint")).alias(c) for c in ("k1", "k2")]
    )
    wholes = written(whole, "whole-conversations")
    return wholes, written(wholes.groupBy(*_KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")


def with_leaves(distinct: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv_id, weight, leaf`` of each sequence; a leaf is no proper prefix of another one."""
    inner = paths.where("d < n").select(*_KEY).distinct()
    leaves = distinct.join(inner, _KEY, "left_anti").withColumn("leaf", F.lit(1).cast("bigint"))
    others = distinct.join(inner, _KEY, "left_semi").withColumn("leaf", F.lit(0).cast("bigint"))
    return leaves.unionByName(others).select("conv_id", "weight", "leaf")


def trie(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations given as ``conv_id, n`` and ``conv_id, d, digest, words``.

    Per node ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    keyed = prefixes(rows)
    wholes, distinct = sequences(known, keyed)
    none = F.lit(0).cast("bigint")
    of_each = distinct.select("conv_id", F.col("d").alias("n"))
    roots = of_each.select("conv_id", *[none.alias(c) for c in (*_KEY, "p1", "p2", "words")], "n")
    paths = written(keyed.join(of_each, "conv_id").unionByName(roots), "paths")
    flagged = with_leaves(distinct, paths)
    merged = paths.join(flagged, "conv_id").groupBy(*_KEY)
    nodes = merged.agg(
        F.sum("weight").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("leaf").alias("n_leaves"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "words")],
    ).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = running(nodes, "conv_id", [F.col("conv_id").asc(), F.col("d").desc()], {"below": ("sum", "saved")}, "trie-nodes")
    # What a sequence has in nodes of its own hangs below each node above them on its path.
    tops = nodes.groupBy("conv_id").agg(F.min("d").alias("top"), F.max("below").alias("all_below")).where("all_below > 0")
    passed = paths.join(tops, "conv_id").where("d < top").groupBy(*_KEY).agg(F.sum("all_below").alias("passed"))
    inner = nodes.where("d > 0")
    children = inner.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(passed, _KEY, "left").join(children, _KEY, "left").join(end_digests(wholes), _KEY, "left")
    with_parent = joined.join(parents, ["d", "p1", "p2"], "left")
    return with_parent.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        "n_leaves",
        (F.col("below") + F.coalesce("passed", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def prefix_nodes(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The trie of all conversations after their heads are exchanged within families of ids."""
    known, rows = rebuilt(turns(conversations), family, most)
    return trie(known, rows)
