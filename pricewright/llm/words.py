"""Words of many texts at once as 64-bit hashes, in numpy.

A word is a run of bytes other than blank and the controls 9 to 13, with A-Z lower-cased.  Its
hash is a polynomial over random numbers of its bytes, taken from one running sum over the
slice, and mixed; two different words share a hash with odds of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, each followed by a blank, and where each text begins and ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    joined = LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    return joined, bounds


def word_spans(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    space = np.concatenate([[True], SPACE[joined], [True]])
    change = np.flatnonzero(space[1:] != space[:-1])
    return change[::2], change[1::2]


def word_hashes(joined: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTES[joined] * up[: len(joined)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row, and the border of each text among them (one more than texts)."""
    joined, bounds = normalised(texts)
    begins, ends = word_spans(joined)
    return word_hashes(joined, begins, ends), np.searchsorted(begins, bounds)
