"""License scan by ordered signature rules.

A text becomes its words, lower-case and one blank apart, in numpy for many texts at once.  An
Aho-Corasick automaton over the keywords of all rules runs over them once; only a rule whose keyword a text
holds is tried on that text, so the hundreds of expressions cost nothing where no licence is named.  Detections whose
word spans contain one another are resolved by priority, then length, then the order of the rules; spans that merely
overlap both stand.  Fixed phrases are looked for in the same way and reported apart, whatever the rules make of them.
Every document is scanned where it lies; nothing is shuffled.

Defined results: a null text is empty and has no words; repeated rows are scanned each for itself; a null id passes
through; an empty table gives an empty result.  Texts are whole, of any length.  Columns are picked by name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .license_rules import BASE, HINT, RULES, Rule, compiled

SLICE = 4 << 20  # bytes of text that are worked on at once
# How sure a rule of each priority is; a fixed phrase counts like a name with its version.
CONFIDENCE = {9: 1.0, 7: 0.9, 5: 0.75, 3: 0.5, 1: 0.25}
FIXED = 7

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True

_HIT = "struct<label:string,rule:int,priority:int,first:bigint,words:bigint,begin:bigint,end:bigint>"
HITS_DDL = f"doc_id bigint, n_words bigint, phrases array<{_HIT}>, licences array<{_HIT}>"


def resolved(found: list[tuple]) -> list[tuple]:
    """What stays of ``(priority, words, first, rule, ...)`` detections, in order of their place.

    They are taken by falling priority, then falling length, place and rule; one whose span contains or lies in the span of
    one taken before it is dropped, and a hint already where it overlaps one.  Spans that stay never contain each other,
    so their ends rise with their begins and a bisection finds all cases.
    """
    begins: list[int] = []
    ends: list[int] = []
    kept = []
    for hit in sorted(found, key=lambda h: (-h[0], -h[1], h[2], h[3])):
        begin, end = hit[2], hit[2] + hit[1]
        before = bisect_right(begins, begin)
        if before and (ends[before - 1] >= end or hit[0] == HINT and ends[before - 1] > begin):
            continue
        after = bisect_left(begins, begin)
        if after < len(begins) and (ends[after] <= end or hit[0] == HINT and begins[after] < end):
            continue
        begins.insert(before, begin)
        ends.insert(before, end)
        kept.append(hit)
    return sorted(kept, key=lambda h: (h[2], h[3]))


class Scanner:
    """The rules made ready: an automaton over their keywords, and their expressions."""

    def __init__(self, rules: tuple[Rule, ...], phrases: tuple[tuple[str, str], ...]):
        self.labels = [r.label for r in rules] + [label for label, _ in phrases]
        self.priorities = [r.priority for r in rules] + [FIXED] * len(phrases)
        self.patterns = [compiled(r.pattern) for r in rules] + [compiled(p) for _, p in phrases]
        self.n_rules = len(rules)
        gates: dict[str, list[int]] = {}
        for i, keyword in enumerate([r.keyword for r in rules] + [p for _, p in phrases]):
            # One character a byte, as the automaton reads the text.
            gates.setdefault(" " + keyword.encode().decode("latin-1"), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, of in gates.items():
            self.automaton.add_word(keyword, of)
        if gates:
            self.automaton.make_automaton()
        self.empty = not gates

    def scan(self, texts: list[str | None]):
        """``n_words, phrases, licences`` of every text."""
        joined, bounds = words.normalised(texts)
        is_word = _WORD[joined]
        change = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
        begins, ends = change[::2], change[1::2]
        border = np.searchsorted(begins, bounds)
        counts = np.diff(border)
        hits: list[tuple[list, list]] = [([], []) for _ in texts]
        # Words one blank apart, with a blank at both ends.
        follows = np.concatenate([[False], is_word[:-1]])
        clean = b" " + np.where(is_word, joined, 32).astype(np.uint8)[is_word | follows].tobytes()
        if not clean.endswith(b" "):
            clean += b" "
        places = 1 + np.concatenate([[0], np.cumsum(ends - begins + 1)])
        tried: dict[int, set[int]] = {}
        if not self.empty:
            for at, of in self.automaton.iter(clean.decode("latin-1")):
                doc = int(np.searchsorted(places[border[1:]], at, "right"))
                tried.setdefault(doc, set()).update(of)
        characters = np.cumsum((joined & 0xC0) != 0x80) if tried else None
        for doc, of in tried.items():
            if doc >= len(texts):
                continue
            a, b = int(border[doc]), int(border[doc + 1])
            if a == b:
                continue
            text, own = clean[places[a] - 1 : places[b]], places[a:b] - places[a] + 1
            base = characters[bounds[doc]] - 1
            found: list[tuple] = []
            for rule in sorted(of):
                for m in self.patterns[rule].finditer(text):
                    first = int(np.searchsorted(own, m.start()))
                    n = text.count(b" ", m.start(), m.end()) + 1
                    begin = int(characters[begins[a + first]] - 1 - base)
                    end = int(characters[ends[a + first + n - 1] - 1] - base)
                    found.append((self.priorities[rule], n, first, rule, begin, end))
            hits[doc] = ([h for h in found if h[3] >= self.n_rules], resolved([h for h in found if h[3] < self.n_rules]))
        return counts.tolist(), hits

    def row(self, hit: tuple) -> dict:
        priority, n, first, rule, begin, end = hit
        return {"label": self.labels[rule], "rule": rule, "priority": priority, "first": first, "words": n, "begin": begin, "end": end}


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(rules, phrases)


_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), *[(n, pa.int64()) for n in ("first", "words", "begin", "end")]])
)


def slices(lengths: list[int], size: int = SLICE):
    """Consecutive ranges of about ``size`` bytes; a longer text is a range of its own."""
    at, room = 0, 0
    for i, n in enumerate(lengths):
        if i > at and room + n > size:
            yield at, i
            at, room = i, 0
        room += n
    if at < len(lengths):
        yield at, len(lengths)


def detections(docs: DataFrame, rules: tuple[Rule, ...] = RULES, phrases: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """``doc_id, n_words, phrases, licences`` of every document.

    ``phrases`` holds all places of the fixed phrases and ``licences`` the detections that stand, each with its label,
    the number of its rule, its words (``first``, ``words``) and its characters in the text (``begin``, ``end``).
    """

    def scan(batches):
        ready = scanner(rules, phrases)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in slices([len(t or "") for t in texts]):
                counts, hits = ready.scan(texts[a:b])
                columns = [pa.array([[ready.row(h) for h in one[i]] for one in hits], _TYPE) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(counts, pa.int64()), *columns], ["doc_id", "n_words", "phrases", "licences"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, HITS_DDL)


def _labels(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(hits["label"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """One flat row per document: places of the phrases, labels, and how sure the surest detection is."""
    phrases, licences = F.col("phrases"), F.col("licences")
    both = F.concat(phrases, licences)
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return found.select(
        "doc_id",
        "n_words",
        F.size(phrases).cast("bigint").alias("n_base"),
        F.array_min(phrases["first"]).alias("first_word"),
        F.array_max(phrases["first"]).alias("last_word"),
        _labels(phrases).alias("base_labels"),
        _labels(both).alias("labels"),
        F.coalesce(F.element_at(sure, F.array_max(both["priority"])), F.lit(0.0)).alias("score"),
        F.size(licences).cast("bigint").alias("n_licences"),
    )
