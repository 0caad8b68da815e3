"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes long with the counts of the bytes that
follow.  A byte is coded in the longest context seen in training, by method D: a symbol seen n times
among N in its context has (2n - 1) / 2N and the escape to the next shorter context q / 2N, q
being the number of different symbols; symbols of the longer context are excluded from the shorter
one.  Below the empty context all bytes never seen are equal.  The trie is learned from
the training rows and stays fixed while texts are scored.

Texts are taken as their lower-cased words with one blank between them and a zero byte at the end,
before which only zeros are seen.  The same pass counts words for the unigram base score.

No task holds the model.  Documents fall into chunks of bounded size by a hash.  Every chunk sends its distinct
byte strings, and words as 64-bit hashes, packed by bucket.  All strings that share the two bytes before the last one share a bucket,
so a bucket has all of the longer contexts it needs; contexts of one byte and none are a table of at most
65,536 numbers that every task gets.  Buckets are merged a bounded number of chunks at a time, priced, and the prices go back to
the chunks that asked.

Defined results: a null text is an empty one, whose only token is the end; repeated rows are scored
alike and each learned from; a row without an id is learned from and not held out; without training rows all
counts are zero; an empty table gives no rows.  Zero bytes inside a text are taken as ends.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, parts, written
from .tokens import slices
from .words import SPACE, mixed, normalised, word_hashes, word_spans

ORDER = 5
CHUNK_BYTES = 16 << 20
FAN = 32
SYMBOLS = 256
GRAMS, WORDS = 0, 1
_EIGHT = np.uint64(8)


class Stream:
    """The bytes to be coded and the words of a slice of texts."""

    def __init__(self, texts: list[str | None]):
        joined, bounds = normalised(texts)
        begins, ends = word_spans(joined)
        self.words = word_hashes(joined, begins, ends)
        self.word_bounds = np.searchsorted(begins, bounds)
        keep = ~SPACE[joined]
        keep[ends] = True  # the blank behind each word
        joined[ends] = 32
        filled = self.word_bounds[1:] > self.word_bounds[:-1]
        last = np.where(filled, 0, bounds[1:] - 1)
        last[filled] = ends[self.word_bounds[1:][filled] - 1]
        keep[last] = True
        joined[last] = 0
        self.bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        self.grams = self._grams(joined[keep].astype(np.uint64))

    def _grams(self, symbols: np.ndarray) -> np.ndarray:
        """Each symbol with the ``ORDER`` before it, as one number; nothing reaches over a text's begin."""
        grams = symbols.copy()
        for k in range(1, ORDER + 1):
            grams[k:] |= symbols[: len(symbols) - k] << np.uint64(8 * k)
        for k in range(ORDER):
            at = self.bounds[:-1] + k
            at = at[at < self.bounds[1:]]
            grams[at] &= np.uint64((1 << 8 * (k + 1)) - 1)
        return grams


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys as their differences, byte place by byte place, deflated."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _tables(keys: np.ndarray, counts: np.ndarray, lowest: int) -> list:
    """(symbol in context, count) tables of the orders from ``lowest`` up, shorter ones as None."""
    out: list = [None] * (ORDER + 1)
    for order in range(ORDER, lowest - 1, -1):
        keys, counts = summed(keys & np.uint64((1 << 8 * (order + 1)) - 1), counts)
        out[order] = (keys, counts)
    return out


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the keys, in order, with the sum and number of what follows."""
    contexts, of = np.unique(keys >> _EIGHT, return_inverse=True)
    return contexts, np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))


def prices(grams: np.ndarray, tables: list) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others."""
    out = np.zeros(len(grams))
    todo = np.ones(len(grams), bool)
    for order in range(ORDER, -1, -1):
        keys, counts = tables[order]
        wanted = grams & np.uint64((1 << 8 * (order + 1)) - 1)
        contexts, sums, kinds = _totals(keys, counts)
        at, known = _find(contexts, wanted >> _EIGHT)
        total = np.where(known, sums[at] if len(sums) else 0, 0.0)
        different = np.where(known, kinds[at] if len(kinds) else 0, 0.0)
        if order < ORDER:  # leave out what the longer context has had
            longer = tables[order + 1][0]
            here, _ = _find(keys, longer & np.uint64((1 << 8 * (order + 1)) - 1))
            contexts, sums, kinds = _totals(longer, counts[here] if len(longer) else np.zeros(0))
            at, known = _find(contexts, (grams & np.uint64((1 << 8 * (order + 2)) - 1)) >> _EIGHT)
            total -= np.where(known, sums[at] if len(sums) else 0, 0.0)
            different -= np.where(known, kinds[at] if len(kinds) else 0, 0.0)
        at, hit = _find(keys, wanted)
        coded = todo & (different > 0) & hit
        out[coded] += np.log10((2.0 * counts[at[coded]] - 1) / (2.0 * total[coded]))
        todo &= ~coded
        escaped = todo & (different > 0)
        out[escaped] += np.log10(different[escaped] / (2.0 * total[escaped]))
    out[todo] -= math.log10(max(1, SYMBOLS - len(tables[0][0])))
    return out


def _buckets(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    of = keys >> _EIGHT & np.uint64(0xFFFF) if kind == GRAMS else keys
    return (mixed(of + np.uint64(1)) % np.uint64(n)).astype(np.int64)


PACKED_DDL = "chunk int, kind int, bucket int, keys binary, counts binary"


def _packed(chunk: int, found: dict, n_buckets: int) -> pa.Table:
    """A row per kind and bucket that occurs."""
    rows = []
    for kind, (keys, counts) in found.items():
        of = _buckets(kind, keys, n_buckets)
        order = np.argsort(of, kind="stable")
        borders = np.searchsorted(of[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            own = np.sort(order[borders[b] : borders[b + 1]])
            if len(own):
                rows.append((chunk, kind, b, pack_keys(keys[own]), counts[own].astype("<i8").tobytes()))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], ["chunk", "kind", "bucket", "keys", "counts"]
    )


def _features(chunked: DataFrame, n_buckets: int) -> DataFrame:
    """The distinct grams and words of each chunk with their counts in training texts."""

    def count(table: pa.Table) -> pa.Table:
        texts, out = table.column("text").to_pylist(), table.column("held_out").to_numpy(zero_copy_only=False)
        parts_of: dict[int, list] = {GRAMS: [], WORDS: []}
        for a, b in slices(texts, 2 << 20):
            stream = Stream(texts[a:b])
            train = ~out[a:b]
            for kind, values, bounds in ((GRAMS, stream.grams, stream.bounds), (WORDS, stream.words, stream.word_bounds)):
                mask = np.repeat(train, np.diff(bounds))
                keys, counts = np.unique(values[mask], return_counts=True)
                parts_of[kind].append((keys, counts))
                others = np.unique(values[~mask])
                parts_of[kind].append((others, np.zeros(len(others), np.int64)))
        found = {
            kind: summed(np.concatenate([k for k, _ in rows]), np.concatenate([c for _, c in rows])) for kind, rows in parts_of.items()
        }
        return _packed(table.column("chunk")[0].as_py(), found, n_buckets)

    return chunked.groupBy("chunk").applyInArrow(count, PACKED_DDL)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    blobs = table.column("keys").to_pylist()
    keys = np.concatenate([unpack_keys(x) for x in blobs]) if blobs else np.zeros(0, np.uint64)
    return keys, np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8")


def _merged(features: DataFrame, n_chunks: int) -> DataFrame:
    """One row per kind and bucket with its training counts, ``FAN`` chunks merged at a time."""

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = summed(*_unpack(table))
        used = counts > 0
        row = [[table.column(c)[0].as_py()] for c in ("chunk", "kind", "bucket")]
        values = [*row, [pack_keys(keys[used])], [counts[used].astype("<i8").tobytes()]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["chunk", "kind", "bucket", "keys", "counts"])

    now, n = features, n_chunks
    while True:
        n = -(-n // FAN)
        now = now.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int"))
        now = written(now.groupBy("chunk", "kind", "bucket").applyInArrow(merge, PACKED_DDL), "ppm-counts")
        if n <= 1:
            return now


def _short_contexts(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of byte pairs over all buckets: at most 65,536 rows."""

    def pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack_keys(row["keys"]) & np.uint64(0xFFFF)
                keys, counts = summed(keys, np.frombuffer(row["counts"], "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    rows = model.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(pairs, "pair bigint, n bigint")
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas().sort_values("pair")
    return found.pair.to_numpy(np.int64).astype(np.uint64), found.n.to_numpy(np.int64)


def _word_totals(model: DataFrame) -> tuple[int, int]:
    """Number of training words and of different ones."""

    def sums(batches):
        for batch in batches:
            counts = [np.frombuffer(x, "<i8") for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())], ["n", "v"]
            )

    rows = model.where(F.col("kind") == WORDS).select("counts").mapInArrow(sums, "n bigint, v bigint")
    found = rows.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return found.n or 0, found.v or 0


def _answers(features: DataFrame, model: DataFrame, pairs: tuple[np.ndarray, np.ndarray], n_chunks: int) -> DataFrame:
    """For every packed row of a chunk the prices of its grams or the counts of its words, in the same order."""
    fans = -(-n_chunks // FAN)
    salted = model.drop("chunk").withColumn("fan", F.explode(F.sequence(F.lit(0), F.lit(fans - 1))))
    asked = features.drop("counts").withColumn("fan", F.floor(F.col("chunk") / FAN).cast("int"))
    shared = features.sparkSession.sparkContext.broadcast(pairs)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = (left if left.num_rows else right).column("kind")[0].as_py() if left.num_rows or right.num_rows else WORDS
        keys, counts = _unpack(right)
        if kind == GRAMS:
            tables = _tables(keys, counts, 2)
            tables[1] = shared.value
            tables[0] = summed(shared.value[0] & np.uint64(0xFF), shared.value[1])
        answers = []
        for blob in left.column("keys").to_pylist():
            wanted = unpack_keys(blob)
            if kind == GRAMS:
                answers.append(prices(wanted, tables).astype("<f4").tobytes())
            else:
                at, known = _find(keys, wanted)
                answers.append(np.where(known, counts[at] if len(counts) else 0, 0).astype("<i8").tobytes())
        return pa.Table.from_arrays(
            [left.column("chunk"), left.column("kind"), left.column("keys"), pa.array(answers, pa.binary())], ["chunk", "kind", "keys", "answers"]
        )

    return (
        asked.groupBy("kind", "bucket", "fan")
        .cogroup(salted.groupBy("kind", "bucket", "fan"))
        .applyInArrow(answer, "chunk int, kind int, keys binary, answers binary")
    )


class Lookup:
    """Open-addressing table from 64-bit keys to values; every key asked for must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(23)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        at = self._first(wanted)
        found = self.slots[at]
        left = np.flatnonzero(self.keys[found] != wanted)
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found[left] = self.slots[at[left]]
            left = left[self.keys[found[left]] != wanted[left]]
        return self.values[found]


SCORE_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, folds: int = 5, fold: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every text of ``doc_id, text`` under a model learned from the rows that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id"), folds, fold).alias("held_out"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if(~F.col("held_out")).alias("ends")).first()
    n_chunks = max(-(-(sizes.n or 0) // chunk_bytes), 2 * spark.sparkContext.defaultParallelism)
    n_buckets = parts(spark)
    # The length keeps rows without an id apart.
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.octet_length("text").cast("bigint"))), F.lit(n_chunks)).cast("int"))
    features = written(_features(chunked, n_buckets), "ppm-features")
    model = _merged(features, n_chunks)
    pairs = _short_contexts(model)
    n_words, n_different = _word_totals(model)
    total = n_words + sizes.ends
    different = n_different + (1 if sizes.ends else 0)
    per_token = total + 0.5 * (different + 1)
    end_score, end_known = math.log10((sizes.ends + 0.5) / per_token), int(sizes.ends > 0)
    answers = _answers(features, model, pairs, n_chunks)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.column("kind").to_numpy()

        def known(kind: int, dtype: str) -> Lookup:
            own = right.filter(pa.array(kinds == kind))
            blobs = own.column("keys").to_pylist()
            keys = np.concatenate([unpack_keys(x) for x in blobs]) if blobs else np.zeros(0, np.uint64)
            return Lookup(keys, np.frombuffer(b"".join(own.column("answers").to_pylist()), dtype))

        columns: list[list[np.ndarray]] = [[], [], [], []]
        texts = left.column("text").to_pylist()
        grams, words = known(GRAMS, "<f4"), known(WORDS, "<i8")
        for a, b in slices(texts, 2 << 20):
            stream = Stream(texts[a:b])
            price = grams.get(stream.grams).astype(np.float64)
            counts = words.get(stream.words)
            logs = np.log10((counts + 0.5) / per_token)
            bounds = stream.word_bounds

            def by_text(values: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[bounds[1:]] - sums[bounds[:-1]]

            columns[0].append(np.diff(bounds) + 1)
            columns[1].append(by_text((counts > 0).astype(np.int64)) + end_known)
            columns[2].append(by_text(logs) + end_score)
            columns[3].append(np.add.reduceat(price, stream.bounds[:-1]))
        tokens, n_known, base, own = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()),
             pa.array(np.full(len(texts), total), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, SCORE_DDL)
