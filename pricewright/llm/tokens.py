"""Fast exact encoding with a public BPE tokenizer.

A BPE tokenizer first cuts a text into pieces that never influence one another.  White space
always ends a piece, so a text can be cut there, each distinct cutting be encoded once by the tokenizers
library and its ids looked up for every further occurrence.  Where a cut could
change a piece (several blanks in a row, control characters, text that the
tokenizer's normaliser changes in other ways than lower-casing) the whole text goes through the
library.  Strings of special tokens inside a text are ordinary text.

The memory is bounded: a full table of known cuttings takes no more, and what it lacks is
encoded when it occurs.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

KNOWN = 250_000  # cuttings that a worker remembers, unless it is told to keep more
LONG = 100  # longer cuttings are not remembered
TOGETHER = 4096  # cuttings that are encoded as one text

# White space other than blank, tab and line ends: such texts go through the library whole.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Characters whose lower case or composition is left to the tokenizer's own normaliser.
_FAR = re.compile("[^\x00-\u024f]")
# A word of nearby letters, and what follows it up to the end; small figures are no letters.
_PLAIN = re.compile("([^\\W\\d_\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]+)([^\\w\\s\u0250-\U0010ffff]*)")
# Where a cut before a blank is not certainly the border of two pieces.
_ODD = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write bytes that do not print as letters from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


_LETTERS = _byte_letters()
_BLANK = chr(_LETTERS[32])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; one per Python worker and tokenizer file."""

    def __init__(self, path: str, known: int = KNOWN):
        self.most = known
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.after_blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.after_blank[[i for piece, i in vocabulary.items() if piece.startswith(_BLANK)]] = True
        self.known: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {}
        # What is known, and behind it room that each call may write over: a full table is not copied again.
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _cut(self, text: str) -> list[str] | None:
        """Cuttings that can be encoded one by one, or None.

        Where blanks belong to the pieces, a cutting stands for itself behind a blank, and
        the first one, behind which no blank is, is marked with a zero.
        """
        if _RARE_SPACE.search(text):
            return None
        if self.keeps_space:
            if text[:1].isspace() or text[-1:] == " " or any(x in text for x in _ODD) or "\0" in text:
                return None
            cut = text.split(" ")
            cut[0] = "\0" + cut[0]
            return cut
        if not text.isascii() and (_FAR.search(text) or not unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower().split()

    def _piece(self, piece: str) -> list[int]:
        """The ids of what is certainly one piece, from the merges alone."""
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def _word(self, word: str) -> list[int]:
        at = self.known.get(word)
        if at is not None:
            return self.ids[self.starts[at] : self.starts[at + 1]].tolist()
        if word.isascii():  # letters stand for themselves, a blank for the letter that byte 32 has
            return [t.id for t in self.tokenizer.model.tokenize(_BLANK + word if self.keeps_space else word)]
        return self._piece(" " + word if self.keeps_space else word)

    def _ids(self, cuttings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all cuttings in a row, and how many each has."""
        if not self.keeps_space:
            return _in_a_row(self._one_by_one(cuttings))
        behind_blank = [i for i, x in enumerate(cuttings) if x[:1] != "\0"]
        rest = [i for i, x in enumerate(cuttings) if x[:1] == "\0"]
        found = [_in_a_row(self._one_by_one([cuttings[i] for i in rest]))]
        for at in range(0, len(behind_blank), TOGETHER):
            found.append(self._together([cuttings[i] for i in behind_blank[at : at + TOGETHER]]))
        ids, sizes = (np.concatenate(x) for x in zip(*found))
        order = np.array(rest + behind_blank, np.int64)
        begins, lengths = np.empty_like(sizes), np.empty_like(sizes)
        begins[order], lengths[order] = np.cumsum(sizes) - sizes, sizes
        return _stretches(ids, begins, lengths), lengths

    def _together(self, cuttings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many cuttings as one text: the blank before each is the first letter of its first id, and of no other."""
        found = np.array(self._whole([" " + " ".join(cuttings)])[0], np.uint32)
        begins = np.flatnonzero(self.after_blank[found])
        if len(begins) != len(cuttings):
            return _in_a_row(self._one_by_one(cuttings))
        return found, np.diff(begins, append=len(found))

    def _one_by_one(self, cuttings: list[str]) -> list[list[int]]:
        """Most cuttings are a word and the marks behind it: two pieces."""
        lists: list[list[int] | None] = []
        for x in cuttings:
            plain = _PLAIN.fullmatch(x)
            if plain is None:
                lists.append(None)
            else:
                word, marks = plain.groups()
                lists.append(self._word(word) + self._mark(marks) if marks else self._word(word))
        rest = [i for i, found in enumerate(lists) if found is None]
        for i, ids in zip(rest, self._whole([self._string(cuttings[i]) for i in rest])):
            lists[i] = ids
        return lists

    def _mark(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._piece(marks)
        return self.marks[marks]

    def _string(self, cutting: str) -> str:
        if not self.keeps_space:
            return cutting
        return cutting[1:] if cutting[0:1] == "\0" else " " + cutting

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        cuts = [self._cut(t) for t in texts]
        odd = [i for i, cut in enumerate(cuts) if cut is None]
        flat = list(chain.from_iterable(cut for cut in cuts if cut is not None))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        gaps = np.flatnonzero(at < 0)
        if len(gaps) or odd:
            unknown = [flat[i] for i in gaps.tolist()]
            missing = dict.fromkeys(unknown)
            room = self.most - len(self.known)
            new = kept = [x for x in missing if len(x) <= LONG][: max(0, room)]
            if len(kept) < len(missing):
                kept_set = set(kept)
                new = kept + [x for x in missing if x not in kept_set]
            n = len(self.known)
            self._put(n, *self._ids(new))
            if odd:
                self._put(n + len(new), *_in_a_row(self._whole([texts[i] for i in odd])))
            places = dict(zip(new, range(n, n + len(new))))
            at[gaps] = np.fromiter(map(places.__getitem__, unknown), np.int64, len(gaps))
            self.known.update(zip(kept, range(n, n + len(kept))))
            if odd:  # put each whole text in its place
                whole = dict(zip(odd, range(n + len(new), n + len(new) + len(odd))))
                rows, begin = [], 0
                for i, cut in enumerate(cuts):
                    rows.append(np.array([whole[i]]) if cut is None else at[begin : begin + len(cut)])
                    begin += 0 if cut is None else len(cut)
                at = np.concatenate(rows)
        per_text = np.array([1 if cut is None else len(cut) for cut in cuts], np.int64)
        first = self.starts[at]
        lengths = self.starts[at + 1] - first
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_text)])]
        return _stretches(self.ids, first, lengths), np.diff(bounds)

    def _put(self, n: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Write entries from the ``n``-th one on, over whatever is there."""
        begin = int(self.starts[n])
        self.starts = _with_room(self.starts, n + 1, len(lengths))
        self.ids = _with_room(self.ids, begin, len(ids))
        self.starts[n + 1 : n + 1 + len(lengths)] = begin + np.cumsum(lengths)
        self.ids[begin : begin + len(ids)] = ids


def _with_room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """An array that begins with the ``used`` values and has room for ``more`` behind them."""
    if used + more <= len(values):
        return values
    grown = np.empty((used + more) * 5 // 4, values.dtype)
    grown[:used] = values[:used]
    return grown


def _in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


def _stretches(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of an array one behind the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begins - ends + lengths, lengths) + np.arange(total)]


def encoder(path: str, known: int = KNOWN) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return remembered(("encoder", path, known), lambda: Encoder(path, known))


def runs(bpe: Encoder, texts: pa.Array, end_id: int):
    """The ids of consecutive texts in a row, each with the end id behind it, and their numbers, a slice of the batch at a time."""
    for a, b, some in text_slices(texts):
        ids, lengths = bpe.encode([t or "" for t in some])
        yield a, b, np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def documents(bpe: Encoder, texts: pa.Array, end_id: int):
    """The ids of each text with the end id behind them, a slice of the batch at a time."""
    for a, b, ids, lengths in runs(bpe, texts, end_id):
        yield a, b, np.split(ids, np.cumsum(lengths)[:-1])


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def crcs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[int]:
    """The same for many stretches of one array."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]


def slices(texts: list[str | None], limit: int = 1 << 20):
    """Ranges of a batch that hold about ``limit`` characters each, one row at least."""
    return ranges([len(t) if t else 0 for t in texts], limit)


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """The same by bytes, with the texts of each range: only one range at a time takes the memory of Python's strings."""
    for a, b in ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()


def ranges(sizes: list[int], limit: int):
    """Ranges of consecutive rows whose sizes add up to about ``limit``, one row at least."""
    begin = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)
    pa.default_memory_pool().release_unused()  # workers wait for their next task with what they hold
