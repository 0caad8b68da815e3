"""Slow and plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(lower(text))


def held_out(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def shingles(text, width):
    found = words(text)
    if len(found) >= width:
        return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}
    return {tuple(found)} if found else set()


def join_components(nodes, links):
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(texts, width, per_cent=80):
    """(number of shingles, component) of each id, all pairs compared."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            both.update((a, b) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n)]
    found = join_components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def trie_scores(train, texts, order):
    """log10 probabilities by a trie of dictionaries, method D with exclusion."""

    def coded(text):
        return b"\0" * order + " ".join(words(text)).encode() + b"\0"

    tries = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        s = coded(text)
        for i in range(order, len(s)):
            for k in range(order + 1):
                tries[k][s[i - k : i]][s[i]] += 1
    out = []
    for text in texts:
        s, total = coded(text), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {x: n for x, n in tries[k].get(s[i - k : i], {}).items() if x not in gone}
                if not seen:
                    continue
                n = sum(seen.values())
                if s[i] in seen:
                    total += math.log10((2 * seen[s[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(seen) / (2 * n))
                gone |= set(seen)
            else:
                total -= math.log10(max(1, 256 - len(tries[0][b""])))
        out.append(total)
    return out


def mix_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until nothing is above its cap; ``sizes`` in order of the sources."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def languages(rows, pieces, folds=4, fold=2, start="▁", smooth=0.1):
    """(lang_pred, score) of each (id, text, lang), by dictionaries: one step from equal weights, then all segmentations summed."""
    known = set(pieces)
    size = len(known) + 1

    def arcs(word):
        marked = start + word
        for a in range(len(marked)):
            for b in range(a + 1, len(marked) + 1):
                piece = marked[a:b]
                if piece in known:
                    yield a, b, piece
                elif b == a + 1:
                    yield a, b, None

    def forward(word, odds):
        sums = [1.0] + [0.0] * (len(word) + 1)
        for a, b, piece in arcs(word):
            sums[b] += sums[a] * odds(piece)
        return sums

    def found(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return [w for w in ("".join(c for c in w if c.isalpha()) for w in words) if w]

    uses, shares = defaultdict(Counter), Counter()
    words_of = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is not None and not held_out(doc_id, folds, fold):
            shares[lang] += 1
            words_of[lang].update(found(text))
    equal = 1 / size
    for lang, counts in words_of.items():
        for word, n in counts.items():
            ahead, spans = forward(word, lambda piece: equal), list(arcs(word))
            behind = [0.0] * (len(word) + 1) + [1.0]
            for a, b, _ in reversed(spans):
                behind[a] += equal * behind[b]
            for a, b, piece in spans:
                uses[lang][piece] += n * ahead[a] * equal * behind[b] / ahead[-1]
    langs = sorted(shares)
    totals = {g: sum(uses[g].values()) + smooth * size for g in langs}
    seen, out = {}, []
    for _, text, _ in rows:
        words = found(text)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        logs = []
        for g in langs:
            log = math.log(shares[g] / sum(shares.values()))
            for w in words:
                if (g, w) not in seen:
                    seen[g, w] = math.log(forward(w, lambda piece, g=g: (uses[g][piece] + smooth) / totals[g])[-1])
                log += seen[g, w]
            logs.append(log)
        best = max(range(len(langs)), key=lambda i: logs[i])
        out.append((langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)))
    return out
