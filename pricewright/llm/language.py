"""Language ID by unigram piece models, summed over all segmentations of a word.

The vocabulary is the word pieces of a public tokenizer file.  Each language has a
probability for every piece; a word's probability is the sum over all ways to cut it into
pieces, found by a forward recursion over its letters.  The probabilities come from one
step of expectation maximisation from equal weights: each training word spreads its count over its pieces by the
posterior of its segmentations.  Words are runs of letters, lower-cased, so lines, marks and digits play no part.

The recursions run over the distinct words of a slice of texts side by side, in numpy.  A task sends at
most one row per language and piece to the driver's sums; the model has vocabulary times
languages numbers.

Defined results: a text that is null or has no letters is ``und`` with score 0; without
training rows every text is; equal scores go to the language first in code-point order; rows
without language are not learned from; a row without an id is learned from and not held out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .tokens import slices

_WORDS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
START = "▁"
SMOOTH = 0.1
KNOWN_WORDS = 700_000


class Pieces:
    """Pieces of letters, with and without a word start, found by a hash of their letters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        self.texts = sorted(x for x in found if x and (x == START or x.removeprefix(START).isalpha()))
        self.unknown = len(self.texts)  # any letter that is no piece
        self.size = self.unknown + 1
        # For each length the hashes of all beginnings of pieces, and the piece that ends there, if any.
        self.longest = max(map(len, self.texts), default=1)
        self.tables = []
        for n in range(1, self.longest + 1):
            begun: dict[str, int] = {}
            for i, x in enumerate(self.texts):
                if len(x) == n:
                    begun[x] = i
                elif len(x) > n:
                    begun.setdefault(x[:n], -1)
            keys = np.zeros(len(begun), np.uint64)
            for k in range(n):
                keys = self.extend(keys, np.array([ord(x[k]) for x in begun], np.uint64))
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array(list(begun.values()), np.int64)[order]))

    @staticmethod
    def extend(keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Hashes of the spans one letter longer."""
        keys = (keys + letters + np.uint64(1)) * _MIX
        return keys ^ keys >> np.uint64(29)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _batches(words: list[str], cells: int = 1 << 20):
    """Words of like lengths together, so that little is padded."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    begin = 0
    while begin < len(order):
        end, widest = begin, 0
        while end < len(order):
            widest = len(words[order[end]]) + 1
            if end > begin and ((end + 1 - begin) * widest > cells or widest > 1.3 * (len(words[order[begin]]) + 1) + 2):
                break
            end += 1
        yield np.array(order[begin:end])
        begin = end


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [START + w for w in words]
    lengths = np.array([len(w) for w in marked])
    out = np.zeros((len(marked), int(lengths.max())), np.uint64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, lengths


def _lattice(vocabulary: Pieces, letters: np.ndarray, lengths: np.ndarray):
    """(begin, length, rows, piece) for every piece that begins at each place of the words.

    A row is followed only as long as its letters begin some piece.
    """
    for begin in range(letters.shape[1]):
        live = np.flatnonzero(lengths > begin)
        keys = np.zeros(len(live), np.uint64)
        for n in range(1, min(vocabulary.longest, letters.shape[1] - begin) + 1):
            keys = vocabulary.extend(keys, letters[live, begin + n - 1])
            known, ids = vocabulary.tables[n - 1]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            going = known[at] == keys
            piece = np.where(going, ids[at], -1)
            if n == 1:
                piece = np.where(piece < 0, vocabulary.unknown, piece)
            hit = piece >= 0
            if hit.any():
                yield begin, n, live[hit], piece[hit]
            going &= lengths[live] > begin + n
            live, keys = live[going], keys[going]
            if not len(live):
                break


def log_probabilities(vocabulary: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log probability of each word (row) in each language: all segmentations summed.

    ``logs`` has a row per piece and a column per language.  Sums are kept relative to a
    running scale, so words of any length neither vanish nor overflow.
    """
    out = np.zeros((len(words), logs.shape[1]))
    odds = np.exp(logs)
    for rows in _batches(words):
        letters, lengths = _letters([words[i] for i in rows])
        width, slots = letters.shape[1], vocabulary.longest + 1
        ring = np.zeros((slots, len(rows), logs.shape[1]))  # sums of the next places
        ring[0] = 1.0
        scale = np.zeros((len(rows), logs.shape[1]))
        arcs = groupby(_lattice(vocabulary, letters, lengths), key=itemgetter(0))
        for place in range(width + 1):
            here = ring[place % slots]
            ended = lengths == place
            if ended.any():
                out[rows[ended]] = np.log(here[ended]) + scale[ended]
            if place == width:
                break
            small = (here < 1e-100) & (here > 0)
            if small.any():
                factor = np.where(small, here, 1.0)
                ring /= factor
                scale += np.log(factor)
            for _, n, live, piece in next(arcs)[1]:
                ring[(place + n) % slots][live] += here[live] * odds[piece]
            ring[place % slots] = 0.0
    return out


def expected_counts(vocabulary: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (row) in each language when all pieces weigh the same.

    ``counts`` has a row per word and a column per language.
    """
    total = np.zeros((vocabulary.size, counts.shape[1]))
    step = np.log(vocabulary.size)
    for rows in _batches(words):
        letters, lengths = _letters([words[i] for i in rows])
        width = letters.shape[1]
        forward = np.full((width + 1, len(rows)), -np.inf)
        forward[0] = 0.0
        arcs = list(_lattice(vocabulary, letters, lengths))
        for begin, n, live, _ in arcs:
            forward[begin + n, live] = np.logaddexp(forward[begin + n, live], forward[begin, live] - step)
        backward = np.full((width + 1, len(rows)), -np.inf)
        backward[lengths, np.arange(len(rows))] = 0.0
        for begin, n, live, _ in reversed(arcs):
            backward[begin, live] = np.logaddexp(backward[begin, live], backward[begin + n, live] - step)
        used = np.concatenate([piece for *_, piece in arcs])
        shares = np.concatenate(
            [np.exp(forward[b, live] - step + backward[b + n, live] - forward[lengths[live], live]) for b, n, live, _ in arcs]
        )
        of = rows[np.concatenate([live for _, _, live, _ in arcs])]
        for i in range(counts.shape[1]):
            total[:, i] += np.bincount(used, shares * counts[of, i], vocabulary.size)
    return total


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    return [w for w in _WORDS.findall(text.lower())]


def _plain(word: str) -> str:
    """A run without the few marks that the pattern lets through but that are no letters."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def train(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log piece probabilities and log shares, from rows of ``text, lang``.

    What reaches the driver has a row per language and piece.
    """

    def count(batches):
        vocabulary = pieces(path)
        sums: dict[str, np.ndarray] = {}
        texts_of: Counter[str] = Counter()
        held: dict[str, Counter[str]] = {}

        def spread() -> None:
            langs = list(held)
            words = sorted({w for c in held.values() for w in c})
            if not words:
                held.clear()
                return
            counts = np.array([[held[g].get(w, 0) for g in langs] for w in words], float)
            found = expected_counts(vocabulary, words, counts)
            for i, g in enumerate(langs):
                sums[g] = sums.get(g, 0) + found[:, i]
            held.clear()

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices(texts):
                for text, lang in zip(texts[a:b], langs[a:b]):
                    texts_of[lang] += 1
                    held.setdefault(lang, Counter()).update(words_of(text))
                for c in held.values():
                    for w in [w for w in c if not w.isalpha()]:
                        c[_plain(w)] += c.pop(w)
                    c.pop("", None)
                if sum(map(len, held.values())) > KNOWN_WORDS // 2:
                    spread()
        spread()
        for lang, n in texts_of.items():
            found = sums.get(lang, np.zeros(vocabulary.size))
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array([-1, *used.tolist()], pa.int64()), pa.array([float(n), *found[used].tolist()])],
                ["lang", "piece", "n"],
            )

    rows = (
        docs.where(F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(count, "lang string, piece bigint, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    vocabulary = pieces(path)
    langs = sorted(rows.lang.unique())
    counts = np.zeros((vocabulary.size, len(langs)))
    shares = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = rows[rows.lang == lang]
        shares[i] = own.n[own.piece == -1].sum()
        own = own[own.piece >= 0]
        counts[own.piece.to_numpy(), i] = own.n
    counts += SMOOTH
    logs = np.log(counts / counts.sum(0))
    return langs, logs, np.log(shares / shares.sum()) if len(langs) else shares




class _Words:
    """Scores of the words a Python worker has met, under one model."""

    def __init__(self, vocabulary: Pieces, logs: np.ndarray):
        self.vocabulary, self.logs = vocabulary, logs
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, logs.shape[1]))

    def rows(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word; a word without letters has zeros."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(at < 0)
        table = self.table
        if len(gaps):
            new = list(dict.fromkeys(words[i] for i in gaps.tolist()))
            values = log_probabilities(self.vocabulary, [_plain(w) for w in new], self.logs)
            values[[not _plain(w) for w in new]] = 0.0
            n = len(table)
            places = dict(zip(new, range(n, n + len(new))))
            at[gaps] = np.fromiter((places[words[i]] for i in gaps.tolist()), np.int64, len(gaps))
            table = np.concatenate([table, values])
            if len(table) <= KNOWN_WORDS:  # a full table takes no more
                self.known.update(places)
                self.table = table
        return table[at]


_words: dict[str, _Words] = {}


def predict(docs: DataFrame, path: str, langs: list[str], logs: np.ndarray, shares: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of rows of ``doc_id, text``; the score is the posterior of the language."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logs, shares))  # vocabulary times languages
    name = uuid.uuid4().hex

    def score(batches):
        langs, logs, shares = model.value
        if name not in _words:
            _words.clear()
            _words[name] = _Words(pieces(path), logs)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            preds, scores = [], []
            for a, b in slices(texts):
                found = [words_of(t) for t in texts[a:b]]
                if not langs:
                    found = [[] for _ in found]
                flat = list(chain.from_iterable(found))
                sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(_words[name].rows(flat), 0)])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                logs_of = sums[ends[1:]] - sums[ends[:-1]] + shares
                for words, row in zip(found, logs_of):
                    if not any(map(str.isalpha, words)) and not any(map(_plain, words)):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(row))
                    preds.append(langs[best])
                    scores.append(float(1.0 / np.exp(row - row[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, "doc_id bigint, lang_pred string, score double"
    )


def identify(docs: DataFrame, path: str, folds: int = 4, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), folds, fold)
    model = train(docs.where(~out), path)
    return predict(docs, path, *model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
