"""Pack documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded where they lie and cut into full sequences and a rest, so that only
piece lengths and checksums travel.  Each piece falls into one of many groups by a hash of its document, place and row, and
every group is packed on its own: pieces by falling length, each into the first bin
that has room.  The tree holds the largest capacity below each node, so the bin is found in
log2(bins) steps.  The number of groups follows the number of documents.

Defined results: a null or empty text is the end id alone; rows that repeat a document, or
lack an id, are packed as documents of their own; equal lengths are taken in order of
(doc_id, start, checksum), nulls last; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

LENGTH = 4096
GROUP_DOCS = 4096
_BINS = 1 << 32  # sequence ids: group * 2**32 + bin


class Tournament:
    """Capacities of ``size`` bins; each inner node knows the largest below it."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1 << max(0, size - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin that has room; its number and what it held before it."""
        node, most = 1, self.most
        while node < self.leaves:
            node *= 2
            if most[node] < need:
                node += 1
        left = most[node]
        most[node] = left - need
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            high = max(most[2 * node], most[2 * node + 1])
            if most[node] == high:
                break
            most[node] = high
        return bin_, left


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; the lengths must not rise."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = [], []
    for n in lengths:
        bin_, left = tree.place(n)
        bins.append(bin_)
        offsets.append(capacity - left)
    return bins, offsets


PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, known: int = tokens.KNOWN) -> DataFrame:
    """Pieces of every document: as many full sequences as it fills, and the rest.  A worker remembers ``known`` cuttings."""

    def cut(batches):
        bpe = tokens.encoder(tokenizer, known)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, encoded in tokens.documents(bpe, batch.column("text"), end_id):
                rows = []
                for doc_id, whole in zip(ids[a:b], encoded):
                    for start in range(0, len(whole), length):
                        piece = whole[start : start + length]
                        rows.append((doc_id, start, len(piece), tokens.crc(piece), len(whole)))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES_DDL)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 11, known: int = tokens.KNOWN
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    n_groups = max(1, -(-docs.count() // group_docs))
    # Pieces are packed each for itself; the row's own number keeps repeated and nameless documents apart.
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.monotonically_increasing_id()), F.lit(n_groups))

    def fill(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        number = group.column("group")[0].as_py()
        ids = np.array(bins, np.int64) + number * _BINS
        return (
            group.drop_columns(["group"])
            .append_column("sequence_id", pa.array(ids, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    return (
        pieces(docs, tokenizer, end_id, length, known)
        .withColumn("group", spread)
        .groupBy("group")
        .applyInArrow(fill, PIECES_DDL + ", sequence_id bigint, offset bigint")
    )
