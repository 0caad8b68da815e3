"""Near-duplicate documents: chosen-path set similarity join over word shingles.

Documents with equal shingle sets are one class from the start, so exact copies cost one row.
In each of several independent trees a node chooses, by a hash of its own path, one or two of
the minwise tokens, 1 / threshold on average; a class goes on to the child named by its token.
So a pair at the threshold is expected to share one node at any depth, while unlike classes part.
Nodes of at most ``LEAF`` classes are compared exhaustively by their signatures; nodes that hold the same
classes as another one are compared once.  Pairs whose estimate lies more than five standard deviations
below the threshold go; all others are confirmed on full sets.

What is still together at the last level shares that many tokens: nodes of near copies.  Their
classes are compared with one of them, and any that are not connected after
that with all of the node, so no cap drops a pair.  Only connections matter, so the best pair of each class is
confirmed first, and of the rest only those whose ends are not connected yet.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing;
with fewer words than a shingle the whole sequence is one; a row without an id is its own
component without a name; rows that repeat an id each get the result of it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .filters import told_apart
from .tokens import ranges, text_slices
from .words import hashed, mixed

TOKENS = 128  # minwise tokens of a class
TREES = 12
LEAF = 24
BLOCK = 256
SALT_ROWS = 256
SLICE = 1 << 18  # bytes of text that are hashed at a time; each takes some 60 bytes of a worker's memory meanwhile

_MULTIPLIERS = np.random.default_rng(77).integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int):
    """The sorted distinct shingle hashes of each text."""
    words, bounds = hashed(texts)
    rolled = words.copy()
    for k in range(1, width):
        rolled[: len(words) - k] = mixed(rolled[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - begin
        if n >= width:
            yield np.unique(rolled[begin : end - width + 1])
        elif n:
            whole = words[begin : begin + 1].copy()
            for k in range(1, n):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + words[begin + k])
            yield mixed(whole + np.uint64(n))
        else:
            yield words[:0]


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """Of the minwise token of each hash function sixteen bits, to choose paths by, and two, to compare by."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max)
    for part in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[part : part + 4096, None] * _MULTIPLIERS).min(0), out=least)
    tokens = mixed(least)
    return (tokens >> np.uint64(48)).astype("<u2").tobytes(), _folded((tokens & np.uint64(3)).astype(np.uint8)).tobytes()


def _folded(pairs: np.ndarray) -> np.ndarray:
    """Four numbers of two bits in each byte."""
    return pairs[0::4] | pairs[1::4] << 2 | pairs[2::4] << 4 | pairs[3::4] << 6


# How many of the four numbers in a byte are zero.
_ZEROS = np.array([sum(not x >> k & 3 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _id() -> Column:
    return F.col("doc_id").cast("bigint")


def _of_text() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, of_text, n_shingles, digest, signature, marks``; no digest for an empty set.

    ``of_text`` is a hash of the text: ids may repeat with other texts, so it names a row with the id.
    """

    def describe(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("of_text")
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                sizes, digests, signatures = [], [], []
                for found in shingle_sets(texts, width):
                    sizes.append(len(found))
                    digests.append(digest_of(found) if len(found) else None)
                    signatures.append(signature(found) if len(found) else (None, None))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([x for x, _ in signatures], pa.binary()), pa.array([x for _, x in signatures], pa.binary())],
                    ["doc_id", "of_text", "n_shingles", "digest", "signature", "marks"],
                )

    return docs.select(_id().alias("doc_id"), "text", _of_text().alias("of_text")).mapInArrow(
        describe, "doc_id bigint, of_text bigint, n_shingles bigint, digest binary, signature binary, marks binary"
    )


def _children(path: Column, sign: Column) -> Column:
    """The nodes a class goes on to: one, or two in a quarter of the nodes (1 / 0.8 on average)."""

    def child(k: int) -> Column:
        token = F.pmod(F.xxhash64(path, F.lit(k)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(path, token, F.substring(sign, token * 2 + 1, F.lit(2)))

    second = F.when(F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0, F.array(child(1), child(2)))
    return F.array_distinct(F.coalesce(second, F.array(child(1))))


def tree_depth(classes: int) -> int:
    """Tokens after which unlike classes, of which a token is shared by one in twenty at most, have parted."""
    return max(3, math.ceil(math.log(max(classes, 2)) / math.log(20)))


def _nodes(classes: DataFrame, trees: int, leaf: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """``cell, rep`` of the small nodes, and of the nodes still large at the end.

    Nodes of the same classes, told by their number and the sum of their hashes, are
    kept once, whatever tree or level they are in.
    """
    rows = classes.select("rep", "signature", F.explode(F.sequence(F.lit(1), F.lit(trees)).cast("array<bigint>")).alias("path"))
    levels = []
    for level in range(1, depth + 1):
        rows = written(rows.select("rep", F.explode(_children(F.col("path"), F.col("signature"))).alias("path")), "nodes")
        sized = rows.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("of")).where("n > 1")
        levels.append(written(rows.join(sized, "path"), "sized"))
        large = levels[-1].where(F.col("n") > leaf)
        if level == depth or large.isEmpty():
            break
        rows = large.select("rep", "path").join(classes.select("rep", "signature"), "rep")
    ends = _union([*[rows.where(F.col("n") <= leaf) for rows in levels], levels[-1].where(F.col("n") > leaf)])
    once = ends.groupBy("n", "of").agg(F.min("path").alias("path")).select("path")
    cells = written(ends.join(once, "path").select(F.col("path").alias("cell"), "rep", "n"), "cells")
    return cells.where(F.col("n") <= leaf).select("cell", "rep"), cells.where(F.col("n") > leaf).select("cell", "rep")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _least_alike(threshold: float) -> int:
    """Equal marks that a pair at the threshold falls short of once in three million times; one in four unequal tokens has equal marks."""
    equal = threshold + (1 - threshold) / 4
    return int(TOKENS * equal - 5 * (TOKENS * equal * (1 - equal)) ** 0.5)


def _compared(cells: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, alike`` for the pairs within small cells whose signatures and sizes allow a link."""
    need = _least_alike(threshold)

    def pairs(table: pa.Table):
        numbers = table.column("cell").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        ends = np.append(starts[1:], len(numbers))
        ids, sizes = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
        signs = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, TOKENS // 4)
        lefts, rights, alikes = [], [], []
        for gap in range(1, int((ends - starts).max())):  # the rows `gap` apart in all cells at once
            left = np.concatenate([np.arange(s, e - gap) for s, e in zip(starts, ends) if e - s > gap])
            right = left + gap
            small, big = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
            fits = small >= threshold * big
            left, right = left[fits], right[fits]
            alike = _ZEROS[signs[left] ^ signs[right]].sum(1, dtype=np.int32)
            some = alike >= need
            lefts.append(ids[left[some]])
            rights.append(ids[right[some]])
            alikes.append(alike[some])
        if lefts:
            left, right = np.concatenate(lefts), np.concatenate(rights)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(np.concatenate(alikes).astype(np.int32))],
                ["a", "b", "alike"],
            )

    def search(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column("cell").to_numpy()
            if not len(numbers):
                continue
            others = np.flatnonzero(numbers != numbers[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column("cell")[0].as_py() != numbers[0]:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    rows = cells.join(classes.select("rep", "n_shingles", "marks"), "rep")
    ordered = rows.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(search, "a bigint, b bigint, alike int").groupBy("a", "b").agg(F.max("alike").alias("alike"))


def _packed(texts: list[str | None]) -> list[bytes]:
    """Texts as they travel: a third of the size of their shingle hashes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]


def _unpacked_sets(blobs: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of packed texts, of which a slice at a time is unpacked."""
    unpack = zstandard.ZstdDecompressor().decompress
    for a, b in ranges([zstandard.frame_content_size(x) for x in blobs], SLICE):
        yield from shingle_sets([unpack(x).decode("utf-8", "surrogatepass") for x in blobs[a:b]], width)


def _sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``rep, packed`` of the classes that occur in pairs: the text that stands for each, from which its full set is worked out.

    A filter of the classes' ids and text hashes lets the other texts stay where they lie.
    """
    needed = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    named = classes.join(needed, "rep", "left_semi").select("rep", "digest", F.col("first.doc_id").alias("id"), F.col("first.of_text").alias("hash"))
    named = written(named.withColumn("mark", F.xxhash64("id", "hash")), "needed")

    def build(batches):
        for batch in batches:
            ids, digests = batch.column("rep"), batch.column("digest").to_pylist()
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                found = shingle_sets(texts, width)
                # Another text of this id could have the same hash.
                right = pa.array([digest_of(x) == of for x, of in zip(found, digests[a:b])], pa.bool_())
                packed = pa.array(_packed(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), packed], ["rep", "packed"]).filter(right)

    texts = docs.select(_id().alias("id"), _of_text().alias("hash"), "text")
    _, maybe = told_apart(texts, F.xxhash64("id", "hash"), named.select("mark"))
    found = maybe.join(named.drop("mark"), ["id", "hash"])
    # Rows that repeat an id and text all make the class's text; one of each is enough.
    built = found.select("rep", "digest", "text").mapInArrow(build, "rep bigint, packed binary")
    return written(built.groupBy("rep").agg(F.min("packed").alias("packed")), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, width: int, per_cent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets link.

    The set of ``b`` travels to ``a`` once per pair; that of ``a`` once for every few hundred
    pairs, so a document with very many partners is spread over tasks, and a task holds
    one set of ``a`` at a time.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    first = counts.join(sets, F.col("a") == F.col("rep")).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "packed"
    )
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    second = salted.join(sets, F.col("b") == F.col("rep")).select("a", "salt", "b", "packed")

    def confirm(batches):
        own, key = None, None
        for batch in batches:
            lefts, rights = [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "salt", "b")]
            for a, salt, b, found in zip(*columns, _unpacked_sets(batch.column("packed").to_pylist(), width)):
                if b is None:
                    own, key = found, (a, salt)
                    continue
                assert key == (a, salt)
                both = len(np.intersect1d(own, found, assume_unique=True))
                if both and 100 * both >= per_cent * (len(own) + len(found) - both):
                    lefts.append(a)
                    rights.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], ["a", "b"])

    ordered = first.unionByName(second).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(confirm, "a bigint, b bigint")


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    left = named.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    right = named.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _agreements(block: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """How many elements each row shares with each set of the block."""
    values, of = np.unique(np.concatenate(block), return_inverse=True)
    flat = np.concatenate(rows)
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    at[values[at] != flat] = len(values)  # a column no set of the block has

    def counted(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        width = len(values) + 1
        cells = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * width + columns
        return np.bincount(cells, minlength=len(sets) * width).reshape(len(sets), width).astype(np.float32)

    held = counted(block, of)
    held[:, -1] = 0
    return counted(rows, at) @ held.T


def _outside(large: DataFrame, named: DataFrame, sets: DataFrame, width: int, per_cent: int) -> DataFrame:
    """``a, b`` of large nodes that link by their full sets and are not connected yet.

    What is outside a node's largest component, if anything, is dealt into blocks; all classes of
    the node pass every block and are compared with all of it.  A task holds one block and sends
    only links that connect what it has not connected yet, never all pairs.
    """
    joined = large.join(named, F.col("rep") == F.col("node"), "left").select("cell", "rep", F.coalesce("component", "rep").alias("of"))
    joined = written(joined, "parts")
    sizes = joined.groupBy("cell", "of").agg(F.count("*").alias("n"))
    parted = (
        sizes.groupBy("cell")
        .agg(F.max(F.struct("n", "of")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("cell", F.col("most.of").alias("of_most"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"))
    )
    rows = joined.join(parted, "cell").join(sets, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    held = rows.where("of <> of_most").withColumn("block", own).withColumn("role", F.lit(0))
    passing = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    both = held.unionByName(passing).select(F.xxhash64("cell", "block").alias("group"), "role", "rep", "of", "packed")

    def compare(block: list, rows: list, root: dict):
        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        fits = _agreements([x for *_, x in block], [x for *_, x in rows])
        large_sizes = np.array([len(x) for *_, x in block], np.float32)
        own_sizes = np.array([len(x) for *_, x in rows], np.float32)
        linked = 100 * fits >= per_cent * (own_sizes[:, None] + large_sizes[None, :] - fits)
        apart = np.array([c for _, c, _ in rows])[:, None] != np.array([c for _, c, _ in block])[None, :]
        for i, j in zip(*np.nonzero(linked & apart)):
            (a, of_a, _), (b, of_b, _) = rows[i], block[j]
            of_a, of_b = find(of_a), find(of_b)
            if of_a != of_b:
                root[max(of_a, of_b)] = min(of_a, of_b)
                yield min(a, b), max(a, b)

    def search(batches):
        group, block, root = None, [], {}
        for batch in batches:
            groups, roles = batch.column("group").to_numpy(), batch.column("role").to_numpy()
            ids, of = batch.column("rep").to_pylist(), batch.column("of").to_pylist()
            found_sets = list(_unpacked_sets(batch.column("packed").to_pylist(), width))
            changes = (groups[1:] != groups[:-1]) | (roles[1:] != roles[:-1])
            borders = np.flatnonzero(np.concatenate([[True], changes, [True]]))
            found: set[tuple[int, int]] = set()
            for begin, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
                if groups[begin] != group:
                    group, block, root = groups[begin], [], {}
                part = list(zip(ids[begin:end], of[begin:end], found_sets[begin:end]))
                if roles[begin] == 0:
                    block += part
                    continue
                for at in range(0, len(block), 64):  # bounds the matrices
                    for k in range(0, len(part), 64):
                        found.update(compare(block[at : at + 64], part[k : k + 64], root))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"]
            )

    return both.repartition("group").sortWithinPartitions("group", "role").mapInArrow(search, "a bigint, b bigint")


def _placed(docs: DataFrame, width: int, per_cent: int, trees: int, leaf: int, depth: int | None) -> DataFrame:
    """``doc_id, of_text, n_shingles, first`` per row; ``first`` is the least ``doc_id, of_text`` of its component, if it has a set.

    A class is known by a number of its own, since an id may stand for several texts.
    """
    threshold = per_cent / 100
    described = written(_described(docs, width), "described")
    members = described.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(
        members.groupBy("digest").agg(F.min(F.struct("doc_id", "of_text")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("marks").alias("marks"))
        # Written at once, so a number never changes.
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    small, large = _nodes(classes, trees, leaf, depth or tree_depth(classes.count()))
    # Each node draws a head of its own, so a family of near copies meets many of its members.
    heads = large.groupBy("cell").agg(F.min(F.struct(F.xxhash64("cell", "rep"), "rep")).alias("head"))
    stars = (
        large.join(heads.select("cell", F.col("head.rep").alias("head")), "cell")
        .where("head <> rep")
        .select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b"))
        .distinct()
    )
    candidates = written(_compared(small, classes, threshold), "candidates")

    # First the best partner of every class, and the heads of the large nodes.
    ends = candidates.select(F.col("a").alias("x"), F.struct("alike", "a", "b").alias("p")).unionByName(
        candidates.select(F.col("b").alias("x"), F.struct("alike", "a", "b").alias("p"))
    )
    best = ends.groupBy("x").agg(F.max("p").alias("p")).select("p.a", "p.b")
    pairs = written(best.unionByName(stars).distinct(), "pairs")
    sets = _sets(pairs, classes, docs, width)
    named = written(components(written(_confirmed(pairs, sets, width, per_cent), "links")), "named")

    # Then what these do not connect: other candidates, and in large nodes those outside its largest component with all.
    across = _outside(large, named, sets, width, per_cent)
    rest = written(_apart(candidates.select("a", "b"), named).unionByName(across).distinct(), "pairs")
    if not rest.isEmpty():
        more = written(_confirmed(rest, sets, width, per_cent), "links")
        if not more.isEmpty():
            stars = named.select(F.col("node").alias("a"), F.col("component").alias("b"))
            named = components(stars.unionByName(more))

    least = classes.join(named, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("first").alias("least"))
    of = named.join(least, "component").select("node", "least")
    per_class = classes.join(of, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("least", "first").alias("first"))
    placed = described.select("doc_id", "of_text", "n_shingles", "digest").join(per_class, "digest", "left")
    return placed.withColumn("first", F.when(F.col("doc_id").isNotNull(), F.col("first")))


def near_duplicates(
    docs: DataFrame, width: int = 2, per_cent: int = 80, trees: int = TREES, leaf: int = LEAF, depth: int | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for rows of ``doc_id, text``."""
    placed = _placed(docs, width, per_cent, trees, leaf, depth)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with the columns they came with.

    Rows go by id and hash of the text, never by the id alone.  A row without an id or without words is a
    component of its own and stays; of rows that repeat the id and text to keep, one stays.
    """
    placed = _placed(docs, width, per_cent, TREES, LEAF, None).where("first IS NOT NULL")
    tied = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("of_text") == F.col("first.of_text"))
    counted = placed.groupBy("doc_id", "of_text").agg(F.count("*").alias("rows"), F.max(tied).alias("tied"))
    named = counted.where("NOT tied OR rows > 1")
    mark = F.xxhash64("doc_id", "of_text").alias("mark")
    named = written(named.select(F.col("doc_id").alias("gone"), F.col("of_text").alias("gone_text"), F.col("tied").alias("gone_tied"), mark), "near-gone")
    single, maybe = told_apart(docs, F.xxhash64(_id(), _of_text()), named.select("mark"))
    named = named.drop("mark")
    same = (_id() == F.col("gone")) & (_of_text() == F.col("gone_text"))
    single = single.unionByName(maybe.join(named, same, "left_anti"))
    several = named.where("gone_tied")
    if several.isEmpty():
        return single
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = maybe.join(several, same, "left_semi").select(_id().alias("id"), _of_text().alias("hash"), whole.alias("row"))
    return single.unionByName(rows.groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
