"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Identical vectors of a label are one class with a size, so a vector that a third of the rows repeat is one row from then
on.  A rotation learned on a bounded sample turns each class into balanced bits.  Tables index substrings of
the code; two classes that share a substring of any table are candidates, and their
original vectors decide.  A pair found in several tables counts in the first only, which the codes tell
without gathering pairs.

The substring grows with the logarithm of the number of classes, so buckets stay small.  The learned code
gives disjoint substrings once only: a pair whose bits differ much there misses all of its tables together.  How often it
does is measured on pairs at the threshold drawn from the sample; further tables read codes of random hyperplanes, new ones
for every code, whose bits differ with probability angle / pi independently, until the recall wanted is met.  A bucket beyond ``BLOCK`` rows is cut into blocks, and every pair of
blocks is a task of its own; blocks send sums and local components, never pairs.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, and one
without label or id links with nothing and is its own component; vectors of different lengths do not link;
rows that repeat an id count as vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

SAMPLE = 20_000  # classes the rotation is learned from at most
BLOCK = 2048
PAIRS = 2000  # of a kind and length, to measure misses on
MISS = 0.02
BITS = 64
THRESHOLD = 0.93


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection: principal directions, rotated so that signs lose least."""
    mean = vectors.mean(0)
    centred = vectors - mean
    values, directions = np.linalg.eigh(centred.T @ centred)
    principal = directions[:, np.argsort(values)[::-1][:bits]]
    projected = centred @ principal
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(principal.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    return mean, principal @ rotation


def _default(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths the sample lacks."""
    square, _ = np.linalg.qr(np.random.default_rng(dimensions).normal(size=(dimensions, dimensions)))
    return np.zeros(dimensions), square[:, :BITS]


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def codes(vectors: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]], several: int = 1) -> np.ndarray:
    """The learned code and, in further columns, codes of random hyperplanes."""
    length = vectors.shape[1]
    mean, projection = model.get(length) or _default(length)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = [_packed((unit - mean) @ projection >= 0)]
    for k in range(1, several):
        out.append(_packed(unit @ np.random.default_rng((length, k)).normal(size=(length, BITS)) >= 0))
    return np.stack(out, 1)


def _width(n: int) -> int:
    return min(24, max(6, math.ceil(math.log2(max(n, 2))) - 4))


def _agree(n: int, threshold: float) -> float:
    return (1 - math.acos(threshold) / math.pi) ** _width(n)


def _learned_tables(n: int, threshold: float, miss: float) -> int:
    return min(BITS // _width(n), math.ceil(math.log(miss) / math.log(1 - _agree(n, threshold))))


def table_masks(n: int, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 2, missed=None) -> list[int]:
    """The bits of each table: disjoint substrings of the learned code, then of as many random codes as are needed.

    ``missed`` tells, for the masks of the learned code, how many pairs at the threshold share none of them; without it
    bits count as independent.
    """
    width, agree = _width(n), _agree(n, threshold)
    order = np.random.default_rng(seed).permutation(BITS)
    masks = [sum(1 << int(b) for b in order[i : i + width]) for i in range(0, BITS - width + 1, width)]
    learned = masks[: _learned_tables(n, threshold, miss)]
    left = (1 - agree) ** len(learned) if missed is None else missed(learned)
    # Random codes know nothing of the pair but its angle, so the misses of both kinds multiply.
    more = max(0, math.ceil(math.log(miss / left) / math.log(1 - agree))) if left > miss else 0
    return learned + [masks[k % len(masks)] for k in range(more)]


def code_numbers(masks: list[int]) -> list[int]:
    """The code each table reads: a new one wherever a mask would use bits again."""
    numbers, number, used = [], 0, 0
    for mask in masks:
        if used & mask:
            number, used = number + 1, 0
        used |= mask
        numbers.append(number)
    return numbers


def sharing(left: np.ndarray, right: np.ndarray, masks: list[int]) -> np.ndarray:
    """Whether the codes of each pair agree in any table."""
    differ, found = left ^ right, np.zeros(len(left), bool)
    for mask, number in zip(masks, code_numbers(masks)):
        found |= (differ[:, number] & np.uint64(mask)) == 0
    return found


def near_pairs(vectors: np.ndarray, threshold: float, seed: int = 3):
    """Pairs at the threshold, of several kinds: vectors of the sample just above it, if there are
    enough, vectors turned that far towards others, and vectors turned towards noise."""
    rng = np.random.default_rng(seed)
    unit = vectors[rng.permutation(len(vectors))[:PAIRS]]
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = np.triu(unit @ unit.T, 1)
    left, right = np.nonzero((cosine >= threshold) & (cosine < threshold + 0.02))
    if len(left) >= 50:
        some = rng.permutation(len(left))[:PAIRS]
        yield unit[left[some]], unit[right[some]]
    own = unit[rng.integers(len(unit), size=PAIRS)]
    for other in (unit[rng.integers(len(unit), size=PAIRS)], rng.normal(size=own.shape)):
        away = other - (own * other).sum(1, keepdims=True) * own
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-6
        if some.any():
            yield own[some], threshold * own[some] + math.sqrt(1 - threshold**2) * away[some] / size[some, None]


def measured_miss(by_length: dict[int, np.ndarray], model: dict, masks: list[int], threshold: float) -> float:
    """The largest share of sampled pairs, over lengths and kinds of pairs, that no table of the learned code finds."""
    return max(
        (
            1 - sharing(codes(a, model), codes(b, model), masks).mean()
            for vectors in by_length.values()
            for a, b in near_pairs(vectors, threshold)
        ),
        default=1.0,
    )


def _sound():
    """Whether a row can link at all; never null."""
    vector = F.col("vector")
    return F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, key`` of the rows that can link, and ``key, rep, size, label, vector`` of the classes."""
    vector = F.col("vector")
    text = F.concat_ws(":", F.col("label").cast("string"), F.array_join(vector.cast("array<string>"), ","))
    usable = rows.where(_sound()).withColumn("key", F.sha2(text, 256))
    grouped = usable.groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    return usable.select("vec_id", "key"), grouped


def _matrix(batch: pa.RecordBatch, dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by length."""
    column = batch.column("vector")
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(dtype)
    first = column.offsets.to_numpy()[:-1]
    return {
        int(n): (rows := np.flatnonzero(lengths == n), flat[first[rows][:, None] + np.arange(n)]) for n in np.unique(lengths)
    }


ENTRY_DDL = "bucket bigint, rep bigint, size bigint, code binary, nth int, vector binary"


def _entries(grouped: DataFrame, model: dict, masks: list[int], narrow: bool) -> DataFrame:
    """A row per class and table: the bucket is a hash of table, label, length and substring.

    ``code`` has the codes up to that of the table.
    """
    numbers = code_numbers(masks)
    shared = grouped.sparkSession.sparkContext.broadcast((model, masks))
    dtype = "<f4" if narrow else "<f8"

    def expand(batches):
        model, masks = shared.value
        for batch in batches:
            for n, (rows, vectors) in _matrix(batch, dtype).items():
                found = codes(vectors.astype(np.float64), model, numbers[-1] + 1)
                taken = batch.take(pa.array(rows))
                label = taken.column("label").to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
                blobs = pa.array([v.tobytes() for v in vectors], pa.binary())
                for nth, mask in enumerate(masks):
                    code = found[:, numbers[nth]]
                    if not nth or numbers[nth] != numbers[nth - 1]:
                        texts = pa.array([c.tobytes() for c in found[:, : numbers[nth] + 1]], pa.binary())
                    key = (code & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) ^ label * np.uint64(0xC2B2AE3D27D4EB4F)
                    key = (key ^ key >> np.uint64(31)) * np.uint64(0x165667B19E3779F9) + np.uint64((nth + 1) * 1000003 + n)
                    key ^= key >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), taken.column("rep"), taken.column("size"), texts,
                         pa.array(np.full(len(rows), nth, np.int32)), blobs],
                        ["bucket", "rep", "size", "code", "nth", "vector"],
                    )

    return grouped.select("rep", "size", "label", "vector").mapInArrow(expand, ENTRY_DDL)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the given edges."""
    least = np.arange(n)
    while True:
        old = least.copy()
        np.minimum.at(least, left, least[right])
        np.minimum.at(least, right, least[left])
        least = least[least]
        if (old == least).all():
            return least


def linked(ids, sizes, code, vectors, side, nth: int, masks: list[int], threshold: float):
    """Within a block, or across two (``side`` 0 and 1): sizes of what each class links with, and its anchor.

    ``code`` has a column per code.  Ids must rise, so that the smallest node is the smallest id.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold - 1e-9
    near = np.triu(near, 1)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    left, right = np.nonzero(near)
    differ = code[left] ^ code[right]
    first = np.ones(len(left), bool)
    numbers = code_numbers(masks[: nth + 1])
    for mask, number in zip(masks[:nth], numbers):
        first &= (differ[:, number] & np.uint64(mask)) != 0
    first &= (differ[:, numbers[nth]] & np.uint64(masks[nth])) == 0  # buckets are hashes
    left, right = left[first], right[first]
    norms = np.linalg.norm(vectors, axis=1)
    cosine = np.einsum("ij,ij->i", vectors[left], vectors[right]) / (norms[left] * norms[right])
    left, right = left[cosine >= threshold], right[cosine >= threshold]
    links = np.bincount(left, sizes[right], len(ids)) + np.bincount(right, sizes[left], len(ids))
    return links.astype(np.int64), ids[local_components(len(ids), left, right)]


def _blocks(entries: DataFrame, block: int) -> DataFrame:
    """Entries with ``cell, side``: small buckets are a cell, large ones a cell for each pair of their blocks."""
    counts = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / block).cast("int")
    placed = entries.join(counts, "bucket").withColumn("cut", cut).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return cells.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "bucket", "rep", "size", "code", "nth", "vector",
    )


def _compare_cell(table: pa.Table, dtype: str, masks: list[int], threshold: float):
    """``rep, links, anchor`` of the classes of one cell that link; a cell may hold buckets whose hashes agree."""
    raw = table.column("vector").to_pylist()
    ids, sizes = table.column("rep").to_numpy(), table.column("size").to_numpy()
    code, side = table.column("code").to_pylist(), table.column("side").to_numpy()
    of = list(zip(table.column("bucket").to_pylist(), table.column("nth").to_pylist(), map(len, raw)))
    for key in dict.fromkeys(of):
        at = np.array([i for i, k in enumerate(of) if k == key])
        if len(at) < 2:
            continue
        at = at[np.argsort(ids[at], kind="stable")]
        vectors = np.frombuffer(b"".join(raw[i] for i in at), dtype).reshape(len(at), -1).astype(np.float64)
        own = np.frombuffer(b"".join(code[i] for i in at), np.uint64).reshape(len(at), -1)
        links, anchor = linked(ids[at], sizes[at], own, vectors, side[at], key[1], masks, threshold)
        some = links > 0
        if some.any():
            yield ids[at][some], links[some], anchor[some]


def _links(cells: DataFrame, narrow: bool, masks: list[int], threshold: float) -> DataFrame:
    """``rep, links, anchor`` rows of all cells, each compared as soon as its last row is there."""
    dtype = "<f4" if narrow else "<f8"
    shared = cells.sparkSession.sparkContext.broadcast(masks)

    def compare(table: pa.Table):
        numbers = table.column("cell").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        sizes = np.diff(np.append(starts, len(numbers)))
        found = [
            part
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist())
            for part in _compare_cell(table.slice(start, size), dtype, shared.value, threshold)
        ]
        if found:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "links", "anchor"])

    def search(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column("cell").to_numpy()
            others = np.flatnonzero(numbers != numbers[-1]) if len(numbers) else []
            if len(others):  # what stands before the last cell is complete
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, others[-1] + 1)]))
                held = [batch.slice(others[-1] + 1)]
            elif held and len(numbers) and held[-1].column("cell")[0].as_py() != numbers[0]:
                yield from compare(pa.Table.from_batches(held))
                held = [batch]
            elif len(numbers):
                held.append(batch)
        if held:
            yield from compare(pa.Table.from_batches(held))

    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(search, "rep bigint, links bigint, anchor bigint")


def duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for rows of ``vec_id, embedding, label``."""
    all_rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label"))
    members, grouped = classes(all_rows)
    members, grouped = written(members, "vector-members"), written(grouped, "vector-classes")
    n = grouped.count()
    narrow = grouped.schema["vector"].dataType.elementType == T.FloatType()
    by_length: dict[int, list] = {}
    # At most `sample` vectors.
    for row in grouped.orderBy("key").limit(sample).select("vector").toPandas().vector:
        by_length.setdefault(len(row), []).append(np.asarray(row, np.float64))
    sampled, model = {length: np.stack(found) for length, found in by_length.items()}, {}
    for length, vectors in sampled.items():
        if len(vectors) > length:
            model[length] = learn_rotation(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), min(BITS, length))
    masks = table_masks(n, threshold, missed=lambda learned: measured_miss(sampled, model, learned, threshold))
    found = written(_links(_blocks(_entries(grouped, model, masks, narrow), block), narrow, masks, threshold), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("rep").alias("a"), F.col("anchor").alias("b")))
    per_class = (
        grouped.select("key", "rep", "size")
        .join(links, "rep", "left")
        .join(of, F.col("rep") == F.col("node"), "left")
        .select("key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known = members.join(per_class, "key").select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~_sound()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
