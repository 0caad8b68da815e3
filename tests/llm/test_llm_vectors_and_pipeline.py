"""Near-duplicate vectors, and the pipeline stage by stage."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from plain import join_components, lower, near_components, words

from pricewright.llm import embeddings, queries
from pricewright.llm.common import table


def plain_links(rows):
    links = []
    usable = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and i is not None and None not in v]
    usable = [(i, v, g) for i, v, g in usable if np.isfinite(v).all() and v.any()]
    for n, (i, v, g) in enumerate(usable):
        for j, w, h in usable[:n]:
            if g == h and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links.append((i, j))
    return links


def check_vectors(rows, got, recall=1.0):
    links = plain_links(rows)
    degree = Counter(x for link in links for x in link)
    assert len(got) == len(rows)
    assert all(r.n_links <= degree[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= recall * sum(degree.values())
    if recall == 1.0:
        found = join_components({i for i, _, _ in rows if i is not None}, links)
        assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == found
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_the_table(spark, small_dir):
    frame = table(spark, small_dir, "embeddings")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in frame.collect()]
    check_vectors(rows, queries.QUERIES["op3_hamming_tables"](spark, small_dir).collect())


def test_vector_recall_at_the_threshold_and_hot_buckets(spark):
    """Families whose members lie just above and below the threshold, and one large family of near copies."""
    rng, rows = np.random.default_rng(6), []
    for family in range(150):
        centre = rng.normal(size=32)
        for _ in range(3):
            rows.append((len(rows), (centre + 0.27 * rng.normal(size=32)).tolist(), family % 3))
    centre = rng.normal(size=32)
    rows += [(len(rows) + k, (centre + 0.02 * rng.normal(size=32)).tolist(), 1) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = embeddings.duplicates(frame, block=32).collect()
    check_vectors(rows, got, recall=0.9)
    family = [r for r in got if r.vec_id >= 450]
    assert {r.component_id for r in family} == {450} and min(r.n_links for r in family) >= 199


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 1.0], 1), (2, [2.0, 0.0, 2.0], 1), (3, [1.0, 0.0, 1.0], 1), (4, [1.0, 0.0, 1.0], 2), (5, None, 1),
        (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 1.0], 1), (8, [1.0, nan, 1.0], 1), (9, [inf, 0.0, 1.0], 1), (10, [1.0, 0.0, 1.0], None),
        (11, [], 1), (12, [1.0, 0.0], 1), (13, [3.0, 0.0], 1), (-1, [1.0, 0.001, 1.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, size int")
    check_vectors(rows, embeddings.duplicates(frame).collect())
    assert embeddings.duplicates(frame.limit(0)).collect() == []
    again = embeddings.duplicates(frame.where("vec_id = 1").union(frame.where("vec_id = 1"))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in again] == [(1, 1, True)] * 2
    lost = embeddings.duplicates(frame.selectExpr("cast(null as bigint) as vec_id", "embedding", "label")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in lost} == {(0, None, True)} and len(lost) == len(rows)


def test_masks_meet_the_miss_rate():
    for n in (100, 10**5, 10**9):
        masks = embeddings.table_masks(n)
        width = masks[0].bit_count()
        agree = (1 - math.acos(0.93) / math.pi) ** width
        assert all(m.bit_count() == width for m in masks) and (1 - agree) ** len(masks) <= embeddings.MISS


def test_recall_with_the_masks_of_large_tables(spark, monkeypatch):
    """Pairs just above the threshold, in tables as they are cut for 100 million classes."""
    rng, rows, turn = np.random.default_rng(12), [], math.acos(0.931)
    for _ in range(400):
        own, other = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows += [(len(rows), own.tolist(), 1), (len(rows) + 1, (math.cos(turn) * own + math.sin(turn) * other).tolist(), 1)]
    # So many others that the code is not learned from the pairs alone.
    rows += [(800 + k, v.tolist(), 2 + k % 50) for k, v in enumerate(rng.normal(size=(4000, 64)))]
    cut = embeddings.table_masks
    monkeypatch.setattr(embeddings, "table_masks", lambda n, *a, **k: cut(10**8, *a, **k))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = embeddings.duplicates(frame).where("vec_id < 800").collect()
    assert {r.n_links for r in got} <= {0, 1} and sum(r.n_links for r in got) >= 0.96 * 800


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """The rows before the first and after each stage."""
    docs, out = table(spark, small_dir, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, small_dir), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_pipeline_stages(spark, small_dir, stages):
    assert [len(s.columns) for s in stages[:-1]] == [5] * 5 and all(s.columns == stages[0].columns for s in stages[:-1])
    rows = [[tuple(r) for r in s.select("doc_id", "text", "source").collect()] for s in stages[:-1]]
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op7_quality_classifier"](spark, small_dir).collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if scores[r[0]] == 1)
    best = {}
    for i, t, s in rows[1]:
        best[lower(t)] = max(best.get(lower(t), i), i)
    assert sorted(i for i, *_ in rows[2]) == sorted(best.values())
    near = near_components({i: t for i, t, _ in rows[2]}, 5)
    assert sorted(i for i, *_ in rows[3]) == sorted({c for _, c in near.values()})
    taken = Counter(i for i, *_ in rows[4])
    assert set(taken) <= {i for i, *_ in rows[3]} and max(taken.values()) <= 3
    sizes = Counter()
    for i, t, _ in rows[4]:
        sizes[i] += len(words(t))
    got = corpus_pipeline.mixing.taken_words(stages[3]).collect()
    assert {r.doc_id: r.taken for r in got if r.taken} == {i: n for i, n in sizes.items() if n}
    pieces = Counter()
    for r in stages[5].collect():
        pieces[r.doc_id] += r.length / r.doc_tokens
    assert {i: round(n, 6) for i, n in pieces.items()} == {i: float(n) for i, n in taken.items()}


def test_pipeline_of_odd_texts(spark, odd_docs, no_docs, small_dir):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for frame in (odd_docs.select(*plain), no_docs.select(*plain)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, small_dir), name.replace(" ", "-"))
        docs.count()


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 0
