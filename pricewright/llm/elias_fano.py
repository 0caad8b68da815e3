"""Token ids as one concatenated array with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents as little-endian 16-bit or 32-bit integers
and, Elias-Fano coded, the position where each document ends and the document
ids.  n values up to u take about n * (2 + log2(u / n)) bits instead of 64 n.  The code stores the low bits packed
and the high bits in unary; every 512th one of the unary part is sampled as a 32-bit
position, so the end of the i-th document is found without decoding the rest.

Shards are rows of a Parquet table in the folder given: Spark's writer commits them, so a
lost executor leaves no half-written file, and any store Spark writes to will do.  Order is (part, seq).

Defined results: a null text is an empty one; an empty document holds the end id alone; null
ids come first; rows that repeat an id stay apart, in any order; an empty table gives no
shards and no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import parts

SAMPLE = 512
BLOCK = 64 * SAMPLE  # values that are coded and decoded at a time
SHARD_IDS = 1 << 22
KNOWN = 800_000  # cuttings that an encoding worker remembers
_HEAD = struct.Struct("<QQB")


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano code of non-decreasing unsigned integers."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    shift = np.uint64(low_bits)
    low = values & np.uint64((1 << low_bits) - 1)
    packed = [np.zeros(0, np.uint8)]
    for at in range(0, n, BLOCK):  # a block ends on a byte, whatever the width
        bits = (low[at : at + BLOCK, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    places = (values >> shift).astype(np.int64) + np.arange(n)
    unary = np.zeros(n + (top >> low_bits) + 1, np.uint8)
    unary[places] = 1
    samples = places[::SAMPLE].astype("<u4")
    return b"".join(
        (
            _HEAD.pack(n, len(unary), low_bits),
            samples.tobytes(),
            np.concatenate(packed).tobytes(),
            np.packbits(unary, bitorder="little").tobytes(),
        )
    )


class EliasFano:
    """Reader of the code."""

    def __init__(self, code: bytes):
        self.n, n_unary, self.low_bits = _HEAD.unpack_from(code)
        at, n_samples = _HEAD.size, -(-self.n // SAMPLE)
        self.samples = np.frombuffer(code, "<u4", n_samples, at)
        at += 4 * n_samples
        n_low = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(code, np.uint8, n_low, at)
        self.unary = np.frombuffer(code, np.uint8, -(-n_unary // 8), at + n_low)

    def values(self, begin: int, end: int) -> np.ndarray:
        """The values from ``begin`` to before ``end``: the stretch between two sampled ones, and nothing else, is decoded."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        sample = begin // SAMPLE
        first, after = sample * SAMPLE, -(-end // SAMPLE)
        bits_begin = int(self.samples[sample])
        byte = bits_begin // 8
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.unary)
        places = np.flatnonzero(np.unpackbits(self.unary[byte:last], bitorder="little")) + 8 * byte
        places = places[np.searchsorted(places, bits_begin) :][begin - first : end - first]
        high = (places - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)
        width, n = self.low_bits, end - first
        low = np.unpackbits(self.low[first * width // 8 :], bitorder="little", count=n * width).reshape(n, width)[begin - first :]
        return high + (low.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def blocks(self):
        """All values, so many at a time that decoding them takes little memory."""
        for begin in range(0, self.n, BLOCK):
            yield begin, self.values(begin, min(begin + BLOCK, self.n))

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[found for _, found in self.blocks()]])

    def rank(self, value: int) -> int:
        """How many values lie below ``value``, by halving with ``select``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        return low

    def select(self, i: int) -> int:
        """The i-th value alone: from the sampled one before it, byte by byte."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = place // 8, place % 8
        word = int(self.unary[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.unary[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        span = bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8])
        low = int.from_bytes(span, "little") >> first % 8 & ((1 << self.low_bits) - 1)
        return (place - i << self.low_bits) + low


SHARD_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()),
     ("first_doc", pa.int64()), ("ends", pa.binary()), ("docs", pa.binary()), ("width", pa.int32()), ("ids", pa.binary())]
)
SHARD_DDL = "part int, seq int, n_docs bigint, n_ids bigint, n_null bigint, first_doc bigint, ends binary, docs binary, width int, ids binary"


_SPANS = ["doc_id", "start", "n_tokens", "ids_crc32"]


class _Shard:
    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.size += len(ids)

    def row(self, part: int, seq: int, width: int) -> pa.RecordBatch:
        known = np.array([x for x in self.doc_ids if x is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        span = known.astype(np.uint64) - np.uint64(first % (1 << 64))  # modulo 2**64, so any two ids will do
        ends = np.cumsum(np.concatenate(self.lengths))
        flat = np.concatenate(self.ids).astype(f"<u{width}")
        values = [part, seq, len(self.doc_ids), self.size, len(self.doc_ids) - len(known), first,
                  ef_encode(ends), ef_encode(span), width, flat.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SHARD_SCHEMA)], schema=SHARD_SCHEMA)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``doc_id, text`` and write shards of about ``shard_ids`` ids in ascending order of the ids."""

    def encode(batches):
        from pyspark import TaskContext

        part, seq, shard = TaskContext.get().partitionId(), 0, _Shard()
        bpe = tokens.encoder(tokenizer, KNOWN)
        width = 2 if max(bpe.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, found, lengths in tokens.runs(bpe, batch.column("text"), end_id):
                ends, at = np.cumsum(lengths), 0
                while at < b - a:  # as many documents as the shard has room for, one at least
                    before = int(ends[at - 1]) if at else 0
                    fits = max(int(np.searchsorted(ends, before + shard_ids - shard.size, "right")), at + (not shard.size))
                    if fits > at:
                        shard.add(ids[a + at : a + fits], found[before : int(ends[fits - 1])], lengths[at:fits])
                    at = fits
                    if at < b - a:
                        yield shard.row(part, seq, width)
                        seq, shard = seq + 1, _Shard()
        if shard.size:
            yield shard.row(part, seq, width)

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(parts(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id")
    )
    ordered.mapInArrow(encode, SHARD_DDL).write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards."""
    shards = spark.read.schema(SHARD_DDL).parquet(folder)
    # One row per task of the writer, then one per shard of it.
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.select("part", "seq", "n_ids")
        .withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(offsets, "part")
        .select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))
    )

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, docs = np.frombuffer(row["ids"], f"<u{row['width']}"), EliasFano(row["docs"])
                base, n_null, before = np.uint64(row["first_doc"] % (1 << 64)), row["n_null"], 0
                for at, found in EliasFano(row["ends"]).blocks():
                    ends = found.astype(np.int64)
                    begins = np.concatenate([[before], ends[:-1]])
                    stop = at + len(ends)
                    known = docs.values(max(0, at - n_null), max(0, stop - n_null)) + base
                    doc_ids = [None] * (len(ends) - len(known)) + known.astype(np.int64).tolist()
                    own = ids[before : ends[-1]].astype("<u4")
                    columns = [doc_ids, begins + row["shard_start"], ends - begins, tokens.crcs(own, begins - before, ends - before)]
                    before = int(ends[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _SPANS)

    # The table of starts has three numbers a shard of millions of ids.
    return shards.join(F.broadcast(starts), ["part", "seq"]).mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def lookup(spark, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of given documents, each row of a repeated id.

    Shards whose first id lies beyond the last one asked for are not read.  In a shard, a document is found by halving over its
    ids, and its place by selecting two ends; nothing else of the codes is decoded.  The list travels with the tasks, so it
    should stay below some hundred thousand ids; ``read`` is for more.
    """
    wanted = sorted(set(doc_ids))

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, docs, ends = np.frombuffer(row["ids"], f"<u{row['width']}"), EliasFano(row["docs"]), EliasFano(row["ends"])
                last = row["first_doc"] + docs.select(docs.n - 1)
                out = []
                for doc_id in wanted[bisect_left(wanted, row["first_doc"]) : bisect_right(wanted, last)]:
                    span = doc_id - row["first_doc"]
                    for k in range(docs.rank(span), docs.rank(span + 1)):
                        at = k + row["n_null"]
                        begin, end = ends.select(at - 1) if at else 0, ends.select(at)
                        out.append({"doc_id": doc_id, "ids": ids[begin:end].astype(np.int64).tolist()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    shards = spark.read.schema(SHARD_DDL).parquet(folder).where(F.col("n_docs") > F.col("n_null"))
    return shards.where(F.col("first_doc") <= F.lit(wanted[-1] if wanted else None)).mapInArrow(find, "doc_id bigint, ids array<bigint>")
