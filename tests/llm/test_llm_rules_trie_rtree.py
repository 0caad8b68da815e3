"""License rules, conversation trie and hard negatives against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import lower
from pyspark.sql import functions as F

from pricewright.llm import conversations, licenses, negatives, queries, scans
from pricewright.llm.common import table
from pricewright.llm.license_rules import BASE, HINT, RULES

# --- licences ---------------------------------------------------------------------

LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_licences(text):
    """n_words, places of the phrases, and the detections that stand, with every rule tried on every text."""
    spans = [(m.start(), m.end()) for m in LICENCE_WORD.finditer(lower(text))]
    found = [lower(text)[a:b] for a, b in spans]
    phrases = [(label, i) for label, p in BASE for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    joined, hits = " " + " ".join(found) + " ", []
    for number, rule in enumerate(RULES):
        for m in re.finditer("(?<= )(?:" + rule.pattern + ")(?= )", joined):
            hits.append((-rule.priority, -len(m.group().split()), joined[: m.start()].count(" ") - 1, number))
    kept = []
    for hit in sorted(hits):
        a, b = hit[2], hit[2] - hit[1]
        if any((c <= a and b <= d) or (a <= c and d <= b) or (-hit[0] == HINT and a < d and c < b) for c, d in kept):
            continue
        kept.append((a, b))
    stand = {(a, b) for a, b in kept}
    out = []
    for p, n, at, number in sorted(hits):
        if (at, at - n) in stand:
            stand.remove((at, at - n))
            out.append((RULES[number].label, -p, text[spans[at][0] : spans[at - n - 1][1]]))
    return len(found), phrases, out


PIECES = [r.pattern for r in RULES if not set(r.pattern) & set("(?[|")] + [p for _, p in BASE]
PIECES += ["GNU General Public License, version 3", "Apache License, Version 2.0", "CC-BY-NC-SA 4.0", "mit", "License", "under the", "ÄÖ word", "copyright (c) 2020"]


@pytest.fixture(scope="module")
def licence_docs(spark, odd_docs):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(PIECES) for _ in range(draw.randint(1, 12))) for _ in range(150)]
    texts += ["Under the MIT-License!", "CC BY\nNC", "cc\x00by nc", "ücc by nc", "cc by ncx", "x" * 100_000 + " mit license " + "y" * 100_000]
    texts += ["under the mit license. " * 20_000 + "cc by nc 4 0 " * 5_000]
    rows = spark.createDataFrame([(100 + i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    return rows.unionByName(odd_docs.select("doc_id", "text", F.lit("x").alias("labels")))


def test_licences_as_all_rules_on_all_texts(licence_docs):
    got = defaultdict(list)
    for r in licenses.detections(licence_docs).collect():
        got[r.doc_id].append(r)
    flat = defaultdict(list)
    for r in licenses.summary(licenses.detections(licence_docs)).collect():
        flat[r.doc_id].append(r)
    for doc_id, text in [(r.doc_id, r.text) for r in licence_docs.collect()]:
        if text is not None and len(text) > 300_000:
            continue  # the plain version compares all pairs
        n, phrases, stand = plain_licences(text or "")
        same = [r for r in got[doc_id] if r.n_words == n]
        assert same, doc_id
        ours = same[0]
        assert Counter((h.label, h["first"]) for h in ours.phrases) == Counter(phrases)
        assert Counter((h.label, h.priority, (text or "")[h.begin : h.end]) for h in ours.licences) == Counter(stand)
        row = [r for r in flat[doc_id] if r.n_words == n][0]
        places = [i for _, i in phrases]
        assert (row.n_base, row.first_word, row.last_word) == (len(places), min(places, default=None), max(places, default=None))
        base = {label for label, _ in phrases}
        assert row.base_labels == ",".join(sorted(base))
        assert row.labels == ",".join(sorted(base | {label for label, *_ in stand}))
        sure = [licenses.CONFIDENCE[p] for _, p, _ in stand] + [licenses.CONFIDENCE[licenses.FIXED]] * bool(places)
        assert row.score == max(sure, default=0.0)


def test_licences_of_a_long_text(licence_docs):
    long = max(licenses.detections(licence_docs).collect(), key=lambda r: len(r.phrases))
    assert len(long.phrases) == 25_000 and Counter(h.label for h in long.licences) == {"mit": 20_000, "cc-by-nc-4": 5_000}


def test_licences_of_the_table(spark, small_dir):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_license_rules"](spark, small_dir).collect()}
    docs = table(spark, small_dir, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        n, phrases, stand = plain_licences(doc.text or "")
        row = rows[doc.doc_id]
        assert (row.n_words, row.n_base) == (n, len(phrases))
        assert row.labels == ",".join(sorted({x[0] for x in phrases} | {x[0] for x in stand}))
    assert any(r.base_labels for r in rows.values())


def test_licence_edges(no_docs, odd_docs):
    assert licenses.detections(no_docs).collect() == []
    assert len(licenses.detections(odd_docs, rules=(), phrases=()).collect()) == odd_docs.count()
    assert len(RULES) > 200 and all(r.priority in licenses.CONFIDENCE for r in RULES)


# --- conversations ----------------------------------------------------------------


def plain_trie(rows):
    """Nodes of the prefixes of all rebuilt conversations, by a dictionary of tuples."""

    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()

    given = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            given[conv_id].append((turn is not None, turn or 0, digest(role, text), role, text))
    turned = {c: [t[3:] for t in sorted(ts)] for c, ts in given.items()}
    whole = {}
    for c, own in turned.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = int(math.fmod(c, 20))
        whole[c] = tuple(turned.get(c - first, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, of in members.items():
        n = (len(of) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += n
            leaves[p[:d]] += not children[p]
    out = Counter()
    for p, of in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in of if whole[c] == p).encode()).hexdigest()
        parent = members[p[:-1]][0] if p else None
        out[(of[0], len(p), parent, len(of), children[p], leaves[p], saved[p], ends)] += 1
    return out


def test_trie_of_random_conversations(spark):
    draw, rows = random.Random(9), []
    for c in range(-25, 140):
        for turn in range(draw.randint(0, 7)):
            rows.append((c, turn, draw.choice(["user", "bot"]), draw.choice(["a b", "a  b c", "ü", ""])))
    rows += [(c, 0, "user", "the same opening") for c in range(200, 260)]  # one large group
    rows += [(300, t % 3, "user", f"word {t}") for t in range(700)]  # one long conversation, with tied turns
    rows += [(7, None, "user", "null turn"), (7, None, None, None), (8, 1, None, "x"), (8, 1, None, "x"), (None, 0, "user", "nobody")]
    rows += [(9_000_000_000, 0, "user", "far"), (9_000_000_000, 0, "user", "far")]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, d int, k1 string")
    got = conversations.prefix_nodes(frame.repartition(5))
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.prefix_nodes(frame).collect() == []
    lone = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert Counter(map(tuple, conversations.prefix_nodes(lone).collect())) == plain_trie([(1, 0, "user", "x")])


def test_running_totals_over_borders(spark):
    """Groups that fill many partitions, and such as lie inside one."""
    rows = [(0, i, i * 7 + 1) for i in range(5000)] + [(g, i, g) for g in range(1, 40) for i in range(g)] + [(99, i, 2) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g bigint, i bigint, v bigint").repartition(4)
    got = scans.running(frame, "g", [F.col("g").asc(), F.col("i").asc()], {"s": ("sum", "v"), "x": ("xor", "v")}, "test").collect()
    want, sums, xors = [], Counter(), Counter()
    for g, i, v in rows:
        sums[g] += v
        xors[g] ^= v
        want.append((g, i, v, sums[g], xors[g]))
    assert sorted(map(tuple, got)) == sorted(want)


# --- hard negatives ---------------------------------------------------------------


def plain_negatives(rows, every=50):
    """All anchors against all rows; rows of id, label, vector of whole numbers."""
    width = max((len(v) for *_, v in rows), default=0)
    wide = [(i, g, np.array(list(v) + [0] * (width - len(v)), object)) for i, g, v in rows]
    out, asked = Counter(), set()
    for a, g, v in wide:
        if a % every or (a, g, tuple(v)) in asked:
            continue
        asked.add((a, g, tuple(v)))
        scored = sorted((-int((v * w).sum()), i, h) for i, h, w in wide)
        for s, p in [(-s, i) for s, i, h in scored if h == g and i != a][:5]:
            fits = [(i, -t) for t, i, h in scored if h != g and 50 * s <= -100 * t <= 95 * s]
            for rank, (i, t) in enumerate(fits[:3], 1):
                out[(a, p, rank, i, s, t)] += 1
    return out


@pytest.fixture
def small_pages(monkeypatch):
    """Trees of several levels and shards on little data."""
    for name, value in (("PAGE", 4), ("FANOUT", 3), ("SHARD", 600), ("BOXES", 7), ("SAMPLE", 4000)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("spread", [3, 40])
def test_negatives_of_families(spark, small_pages, spread):
    rng, rows = np.random.default_rng(5), []
    centres = rng.integers(-200, 200, (12, 9))
    for i in range(900):
        rows.append((i - 30, int(rng.integers(0, 4)), (centres[i % 12] + rng.integers(-spread, spread, 9)).tolist()))
    rows += [(2000 + i, 1, [50] * 9) for i in range(300)]  # many rows with one vector: all ties
    rows += [(50, 1, rows[80][2]), (50, 2, rows[80][2]), (100, 3, [7] * 4), (100, 3, [7] * 4)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, label bigint, vec array<int>, shard int").repartition(3)
    got = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_large_components(spark, small_pages):
    """Scores beyond what doubles hold exactly."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (rng.integers(0, 3, 8) + negatives.MOST - 3).tolist()) for i in range(60)]
    rows += [(100 + i, i % 2, (rng.integers(0, 3, 8) + negatives.MOST * 7 // 10).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label bigint, vec array<int>")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    want = plain_negatives(rows, 10)
    assert want and Counter(map(tuple, got.collect())) == want


def test_vectors_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.5], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0], None), (None, [1.0], 1),
        (7, [], 2), (8, [-0.001, 131071.9], 3), (9, [131072.0], 3),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, vec string")
    got = {r.vec_id: (r.label, r.vec) for r in negatives.whole_vectors(frame).collect()}
    assert got == {1: (1, [128, -128]), 7: (2, []), 8: (3, [-1, 33554406])}
    whole = negatives.whole_vectors(frame)
    assert negatives.hard_negatives(whole, F.lit(True)).collect() == []
    assert negatives.hard_negatives(whole.limit(0), F.lit(True)).collect() == []


def test_tiles_keep_near_rows_together():
    rng = np.random.default_rng(3)
    rows = rng.integers(-100, 100, (2000, 6)).astype(np.int32)
    order, borders = negatives.tile_borders(rows, 64)
    tile = negatives.tiles_of(rows, order, borders)
    assert len(order) == negatives.TILED + 1 and len(set(tile.tolist())) == 64
    assert max(Counter(tile.tolist()).values()) < 3 * 2000 / 64
    inside = [rows[tile == t][:, order[:3]].var(axis=0).mean() for t in set(tile.tolist())]
    assert np.mean(inside) < rows[:, order[:3]].var(axis=0).mean() / 4
