"""Hard negatives by an R-tree packed with sort-tile-recursive.

Rows are cut into slabs by the coordinate that varies most, each slab by the next one, and so on; the borders come from a
sample, which decides only how tight the boxes are, never what is found.  Range partitions in order of (label, tile, next
coordinate) are read as a stream and cut into pages of one label, and pages into shards that a task can hold.  A box gives an interval of each
coordinate and so an interval of its inner products with an anchor.

Anchors are sent to the shards whose box can hold an answer.  A task reads a shard's pages, builds the upper levels of its
tree, and answers the anchors behind them one batch after the other: a queue hands out the box with the highest possible
score, and boxes outside all score windows, or strictly below the k-th best found, are left.  Positives are looked for in the most promising
shard first; the k-th score found there prunes the others.  Results are exact.

Defined results: rows without id, label or vector, or with a component that is null, not finite or beyond ``MOST`` once it
is made whole, take no part; components that a shorter vector lacks count as zero; an anchor is never its own positive, nor is a row
that repeats its id; anchors that repeat id, label and vector are asked once; ties go to the smaller id; an anchor
without positives, and a positive without negatives in its window, have no rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, written

MOST = 1 << 25  # products of components, and sums of 8,192 of them, stay within 64 bits
PAGE = 64  # rows
FANOUT = 16  # boxes under a box
SHARD = 1 << 22  # components that a task holds
SAMPLE = 1 << 20  # components that the borders of tiles are taken from
TILED = 3  # coordinates that tiles are cut by
BOXES = 4096  # shards' boxes that a routing task holds
_LEAST, _GREATEST = -(1 << 62), 1 << 62
_EXACT = 1 << 53


# --- rows -------------------------------------------------------------------------


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part, components made whole by floor(scale * x)."""
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float(MOST // scale)), F.lit(False)))
    return (
        embeddings.where("vec_id is not null and label is not null and embedding is not null")
        .where(usable)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"),
            F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("vec"),
        )
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _unpacked(cells: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int32).reshape(-1, width)


# --- packing ----------------------------------------------------------------------


def tile_borders(sample: np.ndarray, pages: int) -> tuple[list[int], list[np.ndarray]]:
    """Coordinates in falling order of variance, and for each but the last the borders of every tile so far."""
    order = np.argsort(-sample.var(axis=0), kind="stable")[: TILED + 1].tolist() if len(sample) else [0]
    tiled = order[:-1]
    each = max(1, round(min(pages, max(1, len(sample) // 4)) ** (1 / max(1, len(tiled)))))
    borders, tiles = [], [sample]
    for coordinate in tiled:
        cuts, smaller = [], []
        for tile in tiles:
            values = np.sort(tile[:, coordinate])
            at = values[(np.arange(1, each) * len(values)) // each] if len(values) else np.zeros(each - 1)
            cuts.append(at)
            slab = np.searchsorted(at, tile[:, coordinate], "right")
            smaller += [tile[slab == k] for k in range(each)]
        borders.append(np.array(cuts).reshape(len(tiles), each - 1))
        tiles = smaller
    return order, borders


def tiles_of(vectors: np.ndarray, order: list[int], borders: list[np.ndarray]) -> np.ndarray:
    """Number of the tile each vector lies in."""
    tile = np.zeros(len(vectors), np.int64)
    for coordinate, cuts in zip(order, borders):
        inside = (vectors[:, coordinate, None] >= cuts[tile]).sum(axis=1)
        tile = tile * (cuts.shape[1] + 1) + inside
    return tile


_TREE = "shard bigint, kind int, label bigint, ids binary, lo binary, hi binary, vecs binary"


def packed(vectors: DataFrame, n: int, width: int) -> DataFrame:
    """The pages (kind 0) of every shard and its box (kind 1), written to the shared folder."""
    spark = vectors.sparkSession
    wanted = max(PAGE, SAMPLE // width)
    # A row's own number keeps a repeated id from filling the sample.
    drawn = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(max(1, -(-n // wanted)))) == 0
    taken = vectors.where(drawn).select("vec").toArrow().column("vec").combine_chunks()
    order, borders = tile_borders(_matrix(taken, width), -(-n // PAGE))
    most = max(PAGE, SHARD // width)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                found = _matrix(batch.column("vec"), width)
                columns = [pa.array(tiles_of(found, order, borders)), pa.array(found[:, order[-1]]), pa.array([v.tobytes() for v in found])]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "tile", "along", "vec"])

    def pack(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        rows: list[bytes] = []
        label = box = None
        held = 0
        out: list[tuple] = []

        def close_page():
            nonlocal ids, rows, held, box
            if ids:
                page = _unpacked(rows, width)
                lo, hi = page.min(axis=0), page.max(axis=0)
                out.append((base + number, 0, label, np.array(ids, np.int64).tobytes(), lo.tobytes(), hi.tobytes(), page.tobytes()))
                box = (lo, hi) if box is None else (np.minimum(box[0], lo), np.maximum(box[1], hi))
                held += len(ids)
                ids, rows = [], []

        def close_shard():
            nonlocal number, held, box
            close_page()
            if held:
                out.append((base + number, 1, label, b"", box[0].tobytes(), box[1].tobytes(), b""))
                number, held, box = number + 1, 0, None

        def taken_out():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["shard", "kind", "label", "ids", "lo", "hi", "vecs"])

        for batch in batches:
            for vec_id, own, vec in zip(*[batch.column(c).to_pylist() for c in ("vec_id", "label", "vec")]):
                if own != label:
                    close_shard()
                    label = own
                ids.append(vec_id)
                rows.append(vec)
                if len(ids) == PAGE:
                    close_page()
                    if held + PAGE > most:
                        close_shard()
            if out:
                yield taken_out()
        close_shard()
        if out:
            yield taken_out()

    tiled = vectors.mapInArrow(place, "vec_id bigint, label bigint, tile bigint, along int, vec binary")
    tiled = tiled.withColumn("row", F.monotonically_increasing_id())
    keys = ["label", "tile", "along", "vec_id", "row"]
    dealt = tiled.repartitionByRange(_tasks(spark, n, width), *keys).sortWithinPartitions(*keys)
    return written(dealt.mapInArrow(pack, _TREE), "rtree")


def _tasks(spark, n: int, width: int) -> int:
    return max(parts(spark), -(-n * width // SHARD))


# --- search -----------------------------------------------------------------------


def _dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Products of whole numbers held as doubles; where doubles would round, in 64-bit integers."""
    return a @ b if exact else a.astype(np.int64) @ b.astype(np.int64)


class Tree:
    """The pages of a shard and the levels of boxes above them."""

    def __init__(self, width: int, fanout: int = FANOUT):
        self.width, self.fanout = width, fanout
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.levels: list[tuple[np.ndarray, np.ndarray]] | None = None

    def add(self, ids: bytes, lo: bytes, hi: bytes, vectors: bytes) -> None:
        self.ids.append(np.frombuffer(ids, np.int64))
        self.vectors.append(np.frombuffer(vectors, np.int32).reshape(-1, self.width).astype(np.float64))
        self.boxes.append((np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32)))

    def build(self) -> None:
        lo, hi = (np.array([b[i] for b in self.boxes], np.float64).reshape(-1, self.width) for i in (0, 1))
        self.peak = max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))
        self.levels = [(lo, hi)]
        while len(lo) > self.fanout:
            at = np.arange(0, len(lo), self.fanout)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((lo, hi))

    def search(self, q: np.ndarray, windows: list[tuple[int, int]], k: int, but: int | None) -> list[list[tuple[int, int]]]:
        """For each window of scores the first ``k`` rows as (-score, id)."""
        if self.levels is None:
            self.build()
        exact = float(self.peak) * float(np.abs(q).max(initial=0)) * self.width < _EXACT
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        least = [lo for lo, _ in windows]
        most = [hi for _, hi in windows]
        queue: list[tuple] = []

        def wanted(low, high):
            return any(high >= a and low <= b for a, b in zip(least, most))

        def push(level, a, b):
            lo, hi = (x[a:b] for x in self.levels[level])
            highs = (_dot(hi, up, exact) + _dot(lo, down, exact)).tolist()
            lows = (_dot(lo, up, exact) + _dot(hi, down, exact)).tolist()
            for i, (low, high) in enumerate(zip(lows, highs)):
                if wanted(low, high):
                    heapq.heappush(queue, (-high, level, a + i, low))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            high, level, at, low = heapq.heappop(queue)
            if -high < min(least):
                break
            if not wanted(low, -high):
                continue
            if level:
                push(level - 1, at * self.fanout, min((at + 1) * self.fanout, len(self.levels[level - 1][0])))
                continue
            scores, ids = _dot(self.vectors[at], q, exact), self.ids[at]
            for w, (a, b) in enumerate(zip(least, most)):
                hits = np.flatnonzero((scores >= a) & (scores <= b))
                if len(hits):
                    more = [(-int(scores[i]), int(ids[i])) for i in hits if ids[i] != but]
                    found[w] = sorted(found[w] + more)[:k]
                    if len(found[w]) == k:
                        least[w] = max(a, -found[w][-1][0])
        return found


_ASKED = "anchor bigint, vec_id bigint, label bigint, q binary, windows binary"


def _windows(cell: bytes) -> list[tuple[int, int]]:
    return [tuple(w) for w in np.frombuffer(cell, np.int64).reshape(-1, 2).tolist()]


def routed(asked: DataFrame, tree: DataFrame, width: int, same: bool, pick: str) -> DataFrame:
    """``shard`` and the columns of ``asked`` for each shard that may hold an answer.

    ``same``: shards of the anchor's label, else of other labels.  ``pick``: ``best`` takes the shard with the highest possible
    score, of each group of boxes, ``rest`` those that ``best`` leaves, and ``all`` both.  Boxes are copied to each bucket of
    anchors and anchors to each group of boxes, and meet in one task as a stream.
    """
    spark = asked.sparkSession
    boxes = tree.where("kind = 1")
    groups, buckets = max(1, -(-boxes.count() // BOXES)), parts(spark)
    both = F.sequence(F.lit(0), F.lit(buckets - 1))
    left = boxes.select(
        F.explode(both).alias("bucket"), F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"),
        "shard", "label", F.col("lo").alias("one"), F.col("hi").alias("two"), F.lit(0).cast("bigint").alias("anchor"), F.lit(0).cast("bigint").alias("vec_id"),
    )
    right = asked.select(
        F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("shard"), "label", F.col("q").alias("one"), F.col("windows").alias("two"), "anchor", "vec_id",
    )

    def meet(batches):
        at, held, ready = None, [], None
        for batch in batches:
            bucket, group, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "group", "kind"))
            edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(edge, [*edge[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                if (bucket[a], group[a]) != at:
                    at, held = (bucket[a], group[a]), []
                if kind[a] == 0:
                    held.append(part)
                    ready = None
                    continue
                if not held:
                    continue
                if ready is None:
                    own = pa.Table.from_batches(held)
                    lo, hi = (_unpacked(own.column(c).to_pylist(), width).astype(np.float64).T for c in ("one", "two"))
                    ready = own.column("shard").to_numpy(), own.column("label").to_numpy(), lo, hi
                shards, labels, lo, hi = ready
                for c in range(0, part.num_rows, 512):
                    some = part.slice(c, 512)
                    q = _unpacked(some.column("one").to_pylist(), width).astype(np.float64)
                    exact = float(max(np.abs(lo).max(), np.abs(hi).max())) * float(np.abs(q).max(initial=0)) * width < _EXACT
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    highs, lows = _dot(up, hi, exact) + _dot(down, lo, exact), _dot(up, lo, exact) + _dot(down, hi, exact)
                    alike = some.column("label").to_numpy()[:, None] == labels
                    wanted = np.zeros(alike.shape, bool)
                    for i, cell in enumerate(some.column("two").to_pylist()):
                        for least, most in _windows(cell):
                            wanted[i] |= (highs[i] >= least) & (lows[i] <= most)
                    wanted &= alike if same else ~alike
                    if pick != "all":
                        first = np.where(alike, highs, -np.inf).argmax(axis=1)
                        best = np.zeros(alike.shape, bool)
                        best[np.arange(len(best)), first] = True
                        wanted &= best if pick == "best" else ~best
                    row, col = np.nonzero(wanted)
                    out = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shards[col]), *[out.column(c) for c in ("anchor", "vec_id", "label", "one", "two")]],
                        ["shard", "anchor", "vec_id", "label", "q", "windows"],
                    )

    dealt = left.unionByName(right).repartition(buckets, "bucket", "group").sortWithinPartitions("bucket", "group", "kind")
    return dealt.mapInArrow(meet, "shard bigint, " + _ASKED)


_FOUND = "anchor bigint, place int, score bigint, vec_id bigint"


def answered(sent: DataFrame, tree: DataFrame, n: int, width: int, k: int, others: bool) -> DataFrame:
    """``anchor, place, score, vec_id``: per window (``place``) the first ``k`` rows of each shard an anchor was sent to."""
    pages = tree.where("kind = 0").select(
        "shard", F.lit(0).alias("kind"), "ids", "lo", "hi", "vecs", F.lit(0).cast("bigint").alias("anchor"), F.lit(0).cast("bigint").alias("vec_id")
    )
    asked = sent.select(
        "shard", F.lit(1).alias("kind"), F.lit(b"").alias("ids"), F.col("q").alias("lo"), F.col("windows").alias("hi"), F.lit(b"").alias("vecs"), "anchor", "vec_id"
    )

    def search(batches):
        at, own = None, None
        for batch in batches:
            out = []
            for shard, kind, ids, lo, hi, vecs, anchor, vec_id in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != at:
                    at, own = shard, Tree(width, FANOUT)
                if kind == 0:
                    own.add(ids, lo, hi, vecs)
                    continue
                q = np.frombuffer(lo, np.int32).astype(np.float64)
                for place, hits in enumerate(own.search(q, _windows(hi), k, vec_id if others else None)):
                    out += [(anchor, place, -score, found) for score, found in hits]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "score", "vec_id"])

    dealt = pages.unionByName(asked).repartition(_tasks(tree.sparkSession, n, width), "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(search, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _share(score: Column, per_cent: int) -> Column:
    """The largest whole number that is not above this share of a score."""
    times = score.cast("decimal(20,0)") * F.lit(per_cent).cast("decimal(20,0)")
    return F.floor(times / F.lit(100).cast("decimal(20,0)")).cast("bigint")


def _as_cell(windows: Column) -> Column:
    """Pairs of bigint as little-endian bytes, the way numpy reads them."""
    digits = F.array_join(F.transform(windows, lambda w: F.concat(_bytes(w["lo"]), _bytes(w["hi"]))), "")
    return F.unhex(digits)


def _bytes(number: Column) -> Column:
    big = F.lpad(F.hex(number), 16, "0")
    return F.concat(*[F.substring(big, at, 2) for at in range(15, 0, -2)])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows of ``vec_id, label, vec``.

    A positive is one of the first rows of the anchor's label by inner product, a negative one of the first rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's.
    """
    rows = written(vectors.select("vec_id", "label", "vec"), "mined-vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    width = max(1, width)
    tree = packed(rows, n, width)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                cells = pa.array([v.tobytes() for v in _matrix(batch.column("vec"), width)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), cells], ["vec_id", "label", "q"])

    asked = rows.where(is_anchor).mapInArrow(coded, "vec_id bigint, label bigint, q binary").distinct()
    anchors = written(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def window(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))

    open_end = F.lit(_GREATEST)
    start = anchors.withColumn("windows", _as_cell(F.array(window(F.lit(_LEAST), open_end))))
    near = written(answered(routed(start, tree, width, True, "best"), tree, n, width, positives, True), "nearest")
    kth = _first(near, positives).groupBy("anchor").agg(F.min("score").alias("kth"), F.count("*").alias("full")).where(F.col("full") == positives)
    known = anchors.join(kth.select("anchor", "kth"), "anchor", "left")
    pruned = known.withColumn("windows", _as_cell(F.array(window(F.coalesce("kth", F.lit(_LEAST)), open_end)))).drop("kth")
    rest = answered(routed(pruned, tree, width, True, "rest"), tree, n, width, positives, True)
    chosen = written(_first(near.unionByName(rest), positives), "positives")
    bounds = window(-_share(-F.col("score"), low), _share(F.col("score"), high))
    limits = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", bounds.alias("w")))).alias("all"))
    windows = anchors.join(limits, "anchor").withColumn("windows", _as_cell(F.col("all.w"))).drop("all")
    found = answered(routed(windows, tree, width, False, "all"), tree, n, width, negatives, False)
    best = _first(found, negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    of = chosen.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = best.join(of, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
