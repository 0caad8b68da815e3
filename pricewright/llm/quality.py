"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character n-grams of its
words, both hashed into a fixed number of buckets, and of its word pairs, of which only is told
whether the second word is the first again.  The mean counts ``PRIOR`` features without direction in
every document, so that a few odd letters do not decide about a short one.  A linear layer and a
softmax give the class odds.  Training is stochastic gradient descent in numpy on a sample of labelled rows of at most ``SAMPLE`` documents
(smallest hashes of the ids), whose bucket counts the executors work out over whole texts.

The output is linear in the mean, so each distinct word has one pair of numbers: its summed output and
its number of features.  A document's score needs only these, and a worker remembers them.

Defined results: a null or empty text has no features and gets the score of the bias, which follows
the share of the classes; without labelled rows every score is 0.5, with one class alone the
model learns that class; labels other than 0 and 1 or null, and labels of absent documents, are
not learned from; a document labelled twice is learned from twice; rows that repeat an id are scored
each; a row without an id is not held out.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, remembered
from .tokens import text_slices

SAMPLE = 4000  # documents learned from at most
BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (3, 4)
SAME, OTHER = BUCKETS, BUCKETS + 1  # buckets of word pairs
PRIOR = 30
EPOCHS = 8
BATCH = 32
RATE = 4.0
STEEPEST = 1.0  # longer gradients are shortened to this
KNOWN_WORDS = 150_000
LONG = 100  # longer words are not remembered
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Buckets of a word and of its n-grams, with its borders marked."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [zlib.crc32(marked, 1) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def bucket_counts(text: str | None) -> Counter[int]:
    words = (text or "").split()
    total: Counter[int] = Counter()
    if len(words) > 1:
        total[SAME] = sum(map(eq, words, words[1:]))
        total[OTHER] = len(words) - 1 - total[SAME]
    for word, n in Counter(words).items():
        for bucket in features(word):
            total[bucket] += n
    return total


def _shortened(gradients: np.ndarray) -> np.ndarray:
    """Gradients, one a row, with none longer than ``STEEPEST``."""
    length = np.linalg.norm(gradients, axis=-1, keepdims=True)
    return gradients * (STEEPEST / np.maximum(length, STEEPEST))


class Model:
    """Vectors of the buckets, output weights and bias for two classes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1, 1, (BUCKETS + 2, DIMENSIONS)).astype(np.float64) / DIMENSIONS
        self.weights = np.zeros((DIMENSIONS, 2))
        self.bias = np.zeros(2)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
        """Stochastic gradient descent over (buckets, shares, label); the rate falls to zero."""
        rng = np.random.default_rng(seed)
        steps, step = epochs * -(-len(rows) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for begin in range(0, len(rows), BATCH):
                chosen = [rows[i] for i in order[begin : begin + BATCH]]
                lr = rate * (1 - step / steps)
                step += 1
                means = np.stack([shares @ self.vectors[buckets] for buckets, shares, _ in chosen])
                labels = np.array([label for *_, label in chosen])
                out = means @ self.weights + self.bias
                odds = np.exp(out - out.max(1, keepdims=True))
                slope = odds / odds.sum(1, keepdims=True)
                slope[np.arange(len(chosen)), labels] -= 1
                to_means = _shortened(slope @ self.weights.T)
                self.weights -= lr * _shortened((means.T @ slope).ravel()).reshape(self.weights.shape)
                self.bias -= lr * slope.mean(0)
                for (buckets, shares, _), g in zip(chosen, to_means):
                    self.vectors[buckets] -= lr * shares[:, None] * g
        return self

    def outputs(self) -> tuple[np.ndarray, float]:
        """How far each bucket, and the bias, speak for class 1."""
        towards = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors @ towards, float(self.bias[1] - self.bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int = SAMPLE) -> DataFrame:
    """``buckets, counts, quality`` of at most ``sample`` labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("labelled"), "labelled", "quality")
        .limit(sample)
    )
    # At most `sample` rows of two numbers.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))

    def count(batches):
        for batch in batches:
            qualities = batch.column("quality").to_pylist()
            for a, b, texts in text_slices(batch.column("text")):
                found = [sorted(bucket_counts(t).items()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([np.array([k for k, _ in f], "<u2").tobytes() for f in found], pa.binary()),
                        pa.array([np.array([n for _, n in f], "<f4").tobytes() for f in found], pa.binary()),
                        pa.array(qualities[a:b], pa.int32()),
                    ],
                    ["buckets", "counts", "quality"],
                )

    counted = joined.select("text", "quality").mapInArrow(count, "buckets binary, counts binary, quality int")
    # An id may stand for many rows, so the bound holds for rows too.
    return counted.orderBy(F.xxhash64("buckets", "counts"), "buckets", "counts", "quality").limit(sample)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model:
    """Fit on the driver: the sample and the size of its rows are bounded by ``sample`` and ``BUCKETS``."""
    rows = []
    for row in sorted(labelled_sample(docs, labels, folds, fold, sample).collect(), key=lambda r: (r.quality, r.buckets, r.counts)):
        counts = np.frombuffer(row["counts"], "<f4")
        if len(counts):
            shares = counts / np.float32(counts.sum(dtype=np.float64) + PRIOR)
            rows.append((np.frombuffer(row["buckets"], "<u2"), shares, row["quality"]))
    return Model().fit(rows)


class _Words:
    """Summed output and number of features of the words a Python worker has met."""

    def __init__(self, outputs: np.ndarray):
        self.outputs = outputs
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 2))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, alike only for the same word, and the table the numbers point into."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(at < 0)
        if not len(gaps):
            return at, self.table
        new = sorted({words[i] for i in gaps.tolist()}, key=len)  # long ones last
        found = [features(w) for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = self.outputs[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))]
        values = np.stack([np.add.reduceat(flat, np.cumsum(sizes) - sizes), sizes], 1)
        n = len(self.table)
        places = dict(zip(new, range(n, n + len(new))))
        at[gaps] = np.fromiter((places[words[i]] for i in gaps.tolist()), np.int64, len(gaps))
        table = np.concatenate([self.table, values])
        short = sum(len(w) <= LONG for w in new)
        if n + short <= KNOWN_WORDS:  # a full table takes no more
            self.known.update(zip(new[:short], range(n, n + short)))
            self.table = table[: n + short]
        return at, table


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The rows, which have a ``text``, with ``quality_score`` behind their own columns."""
    outputs, bias = model.outputs()
    shared = rows.sparkSession.sparkContext.broadcast(outputs)  # one number per bucket
    name = uuid.uuid4().hex

    # Only the texts go to Python, and only the scores come back.
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = remembered(("quality", name), lambda: _Words(shared.value))
        for batch in batches:
            scores = []
            for _, _, texts in text_slices(batch):
                found = [(t or "").split() for t in texts]
                at, table = words.rows(list(chain.from_iterable(found)))
                sizes = np.array([len(x) for x in found])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                again = np.concatenate([[0.0], at[1:] == at[:-1]])[: len(at)]
                again[ends[:-1][sizes > 0]] = 0.0  # the first word of a text has none before it
                sums = np.concatenate([np.zeros((1, 3)), np.cumsum(np.column_stack([table[at], again]), 0)])
                speaks, n, same = (sums[ends[1:]] - sums[ends[:-1]]).T
                pairs = np.maximum(sizes - 1, 0)
                speaks = speaks + same * shared.value[SAME] + (pairs - same) * shared.value[OTHER]
                scores.append(1.0 / (1.0 + np.exp(-(speaks / (n + pairs + PRIOR) + bias))))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return rows.withColumn("quality_score", score("text"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, folds, fold)
    rows = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    model = train(docs, labels)
    columns = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("rest"))
    kept = scored(packed, model).where(F.col("quality_score") >= threshold)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns])
