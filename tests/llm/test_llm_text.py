"""Scoring, near dedup, language, quality, shards and packing against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import held_out, near_components, trie_scores, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricewright.llm import chosen_path, elias_fano, language, packing, ppm, quality, queries, tokens
from pricewright.llm import components as graph
from pricewright.llm.common import table
from pricewright.session import fresh_path

BYTES, WORDS, PIECES = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows_of(docs, *names):
    return [tuple(r) for r in docs.select(*names).collect()]


# --- language-model score ---------------------------------------------------------


def check_scores(docs):
    rows = rows_of(docs, "doc_id", "text")
    train = [t for i, t in rows if not held_out(i, 5, 1)]
    counts = Counter(w for t in train for w in words(t))
    counts["\0end"] = len(train)
    total, different = sum(counts.values()), sum(n > 0 for n in counts.values())

    def log(w):
        return math.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1)))

    want = {}
    for (i, t), own in zip(rows, trie_scores(train, [t for _, t in rows], ppm.ORDER)):
        found = [*words(t), "\0end"]
        want[(i, len(found))] = (held_out(i, 5, 1), sum(counts[w] > 0 for w in found), total, sum(map(log, found)), own)
    got = ppm.score(docs, chunk_bytes=4000).collect()
    assert len(got) == len(rows)
    for r in got:
        out, known, n, base, own = want[(r.doc_id, r.n_tokens)]
        assert (r.held_out, r.n_known, r.train_tokens) == (out, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own, rel=1e-5)


def test_scores_of_a_plain_trie(spark, small_dir):
    check_scores(table(spark, small_dir, "documents").limit(60))


def test_scores_of_odd_texts(odd_docs, no_docs):
    check_scores(odd_docs)
    assert ppm.score(no_docs).collect() == []


def test_scores_without_training_rows(odd_docs):
    alone = odd_docs.where("doc_id = 5 OR doc_id = 2")
    out = [i for i in (2, 5) if held_out(i, 5, 1)]
    check_scores(alone)
    none = odd_docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.lit(next(i for i in range(99) if held_out(i, 5, 1))).cast("bigint"))
    got = ppm.score(none).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isfinite(r.score) for r in got) and len(out) >= 0


def test_model_beats_the_unigrams(spark):
    got = queries.QUERIES["op1_ppm_score"](spark, "/root/testdata/sf0.1").where("held_out")
    assert got.agg(F.sum("score") > F.sum("base_score")).first()[0]


def test_prices_are_probabilities():
    rng = np.random.default_rng(4)
    grams = rng.integers(97, 101, (300, ppm.ORDER + 1)).astype(np.uint64)
    keys = sum(grams[:, k] << np.uint64(8 * k) for k in range(ppm.ORDER + 1))
    tables = ppm._tables(*ppm.summed(keys, np.ones(len(keys), np.int64)), 0)
    for context in (keys[0] >> np.uint64(8), np.uint64(0x6161616161), np.uint64(0x7A7A7A7A7A)):
        asked = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** ppm.prices(asked, tables)).sum() == pytest.approx(1)


# --- near dedup -------------------------------------------------------------------


@pytest.mark.parametrize("width", [2, 5])
def test_near_components(spark, small_dir, width):
    docs = table(spark, small_dir, "documents")
    want = near_components(dict(rows_of(docs, "doc_id", "text")), width)
    got = chosen_path.near_duplicates(docs, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_of_odd_texts(odd_docs, no_docs):
    want = near_components({i: t for i, t in rows_of(odd_docs, "doc_id", "text") if i is not None}, 2)
    got = chosen_path.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert chosen_path.near_duplicates(no_docs).collect() == []
    kept = chosen_path.keep_one(odd_docs, 5)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IN (6, 8)").count() == 0


def test_near_keep_one_of_ids_with_several_texts(spark):
    """An id loses the text that is a near copy, not its others; of repeated rows one stays."""
    words_of = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [
        (5, words_of("p")), (5, words_of("q")), (2, words_of("p") + " more"), (7, words_of("r")), (7, words_of("r")),
        (8, words_of("r") + " end"), (9, words_of("s")), (9, words_of("s") + " end"), (None, words_of("p")), (None, ""), (1, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(tuple(r) for r in chosen_path.keep_one(docs, 5).collect())
    nines = [r for r in rows if r[0] == 9 and got[r]]
    want = [(2, words_of("p") + " more"), (5, words_of("q")), (7, words_of("r")), (None, words_of("p")), (None, ""), (1, "")]
    assert len(nines) == 1 and got == Counter(want + nines)
    ids = {(r.doc_id, r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs, 5).where("doc_id = 5").collect()}
    assert ids == {(5, 56, 2), (5, 56, 5)}


def test_near_hot_group(spark):
    """One family of edited copies that is most of the table, larger than a leaf at any depth."""
    rng, base = np.random.default_rng(8), [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        copy = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            copy[at] = f"x{rng.integers(10**6)}"
        texts[i] = " ".join(copy)
    texts |= {i: " ".join(f"u{rng.integers(10**6)}" for _ in range(30)) for i in range(400, 500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = near_components(texts, 2)
    for depth in (2, 8):
        got = chosen_path.near_duplicates(docs, leaf=8, depth=depth).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_shingle_threshold_is_exact(spark):
    # 9 shingles against the first 8 of them is 8/9; 5 against 4 is exactly 0.8; 4 against 3 is below.
    lines = {1: "a b c d e f", 2: "a b c d e", 3: "p q r s t", 4: "p q r s"}
    docs = spark.createDataFrame(list(lines.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, trees=30).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 100), (7, 7), (200, 201), (201, 199), (None, 3)]
    links += [(500, k) for k in range(501, 700)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100: 60, 60: 60, 199: 199, 200: 199, 201: 199} | {k: 500 for k in range(500, 700)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- language ---------------------------------------------------------------------


def test_sum_over_all_segmentations():
    vocabulary = language.pieces(PIECES)
    number = {t: i for i, t in enumerate(vocabulary.texts)}
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(vocabulary.size), 2).T + 1e-12)

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            piece = number.get(text[:n], vocabulary.unknown if n == 1 else None)
            if piece is not None:
                out = out + np.exp(logs[piece]) * total(text[n:])
        return out

    found = ["the", "straße", "x", "漢字", "heitung", "qzx"]
    got = language.log_probabilities(vocabulary, [*found, "ab" * 4000], logs)
    assert np.allclose(got[:-1], [np.log(total("▁" + w)) for w in found])
    assert np.isfinite(got).all()
    counts = language.expected_counts(vocabulary, ["the", "x"], np.array([[2.0, 0], [0, 3]]))
    letters = np.array([len(t.removeprefix("▁")) for t in vocabulary.texts] + [1])
    assert np.allclose(letters @ counts, [6, 3])  # every letter of every word is in one piece


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_language_id"](spark, sf_dir).where("held_out")
    joined = got.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    right, n = joined.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right >= 0.98 * n


def test_language_as_a_plain_version_learns_and_predicts(spark, small_dir, odd_docs):
    """Training and prediction as a whole, on a table and on odd texts."""
    frame = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang")
    for docs in (frame, frame.unionByName(odd_docs.select("doc_id", "text", "lang").where("length(text) < 1000 or text is null"))):
        rows = [tuple(r) for r in docs.collect()]
        want = Counter((i, lang, round(score, 6)) for (i, *_), (lang, score) in zip(rows, plain.languages(rows, language.pieces(PIECES).texts)))
        assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify(docs, PIECES).collect()) == want


def test_language_of_odd_texts(odd_docs, no_docs):
    got = {(r.doc_id, r.held_out): r for r in language.identify(odd_docs, PIECES).collect()}
    for i in (2, 3, 4, 9):
        assert (got[(i, held_out(i, 4, 2))].lang_pred, got[(i, held_out(i, 4, 2))].score) == ("und", 0.0)
    assert got[(None, False)].held_out is False
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und") for r in got.values())
    assert language.identify(no_docs, PIECES).collect() == []
    unknown = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


# --- quality ----------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.QUERIES["op7_quality_classifier"](spark, sf_dir).where("held_out")
    joined = got.join(table(spark, sf_dir, "labels"), "doc_id")
    right, n = joined.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 700 and right >= 0.97 * n


def test_quality_score_is_the_mean_of_the_features(odd_docs, labels):
    model = quality.train(odd_docs, labels)
    outputs, bias = model.outputs()
    want = Counter()
    for i, text in rows_of(odd_docs, "doc_id", "text"):
        counts = quality.bucket_counts(text)
        mean = sum(outputs[b] * n for b, n in counts.items()) / (sum(counts.values()) + quality.PRIOR)
        want[(i, round(1 / (1 + math.exp(-mean - bias)), 9))] += 1
    got = quality.classify(odd_docs, labels).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id, 5, 0) for r in got)


def test_quality_without_rows_or_labels(odd_docs, no_docs, labels):
    assert quality.classify(no_docs, labels).collect() == []
    assert {r.score for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


# --- token shards -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=700), st.integers(0, 63))
def test_elias_fano(values, shift):
    values = sorted(v >> shift for v in values)
    code = elias_fano.EliasFano(elias_fano.ef_encode(np.array(values, np.uint64)))
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(0, len(values), 13)] == values[::13]


def test_elias_fano_in_blocks():
    rng = np.random.default_rng(7)
    for step in (0, 3, 1 << 40):
        values = np.cumsum(rng.integers(0, step + 1, 3 * elias_fano.BLOCK + 77, np.uint64))
        code = elias_fano.EliasFano(elias_fano.ef_encode(values))
        assert (code.all() == values).all()
        for begin, end in ((0, 1), (511, 513), (512, 1024), (elias_fano.BLOCK - 1, elias_fano.BLOCK + 600), (len(values) - 3, len(values)), (9, 9)):
            assert (code.values(begin, end) == values[begin:end]).all()
        for i in (0, 512, 70_000, len(values) - 1):
            assert code.rank(int(values[i])) == np.searchsorted(values, values[i])


def test_lookup_of_documents(spark, odd_docs, no_docs, tmp_path):
    """Given documents by select, among negative, repeated and null ids and many shards."""
    bpe = tokens.encoder(BYTES)
    for size in (1, 400, 1 << 22):
        folder = str(tmp_path / f"lookup{size}")
        elias_fano.write(odd_docs, folder, BYTES, shard_ids=size)
        got = Counter((r.doc_id, tuple(r.ids)) for r in elias_fano.lookup(spark, folder, [5, -4, 8, 3, 77, 5]).collect())
        rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id in (5, -4, 8, 3)]
        assert got == Counter((i, (*bpe.tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
        assert elias_fano.lookup(spark, folder, []).collect() == []
    elias_fano.write(no_docs, str(tmp_path / "none"), BYTES)
    assert elias_fano.lookup(spark, str(tmp_path / "none"), [1]).collect() == []


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(elias_fano.ef_encode(ends)) * 8 < 100_000 * (2 + math.log2(1000) + 1)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Z9'.  \n\t\r\x0b\x1c\x85\xa0éÉİıΣσς€ǅ漢👩\u0301ñｱ()!?\0")) | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_cached_encoding_is_the_library_s(texts):
    for path in (BYTES, WORDS):
        whole = tokens.encoder(path).tokenizer
        ids, lengths = tokens.encoder(path).encode(texts)
        want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want


def encoded(docs, path, end):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows_of(docs, "doc_id", "text")]


def test_shards_round_trip(spark, odd_docs, no_docs, small_dir):
    for docs in (odd_docs, table(spark, small_dir, "documents")):
        folder = fresh_path(spark, "shards")
        elias_fano.write(docs, folder, BYTES, shard_ids=5000)
        assert spark.read.parquet(folder).count() > 5
        got = elias_fano.read(spark, folder).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in encoded(docs, BYTES, 0))
        end, last = 0, None
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == end and (last is None or r.doc_id is not None and r.doc_id >= last)
            end, last = r.start + r.n_tokens, r.doc_id
    folder = fresh_path(spark, "shards")
    elias_fano.write(no_docs, folder, BYTES)
    assert elias_fano.read(spark, folder).collect() == []


# --- packing ----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    left, want = [], []
    for n in lengths:
        bin_ = next((i for i, room in enumerate(left) if room >= n), len(left))
        if bin_ == len(left):
            left.append(50)
        want.append((bin_, 50 - left[bin_]))
        left[bin_] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths, 50))) == want


def test_packing(spark, odd_docs, no_docs, small_dir):
    for docs in (odd_docs, table(spark, small_dir, "documents")):
        got = packing.pack(docs, WORDS, group_docs=50).collect()
        ids = Counter((i, len(x), crc(x[s : s + 4096]), s) for i, x in encoded(docs, WORDS, 2) for s in range(0, len(x), 4096))
        assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32, r.start) for r in got) == ids
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in sequences.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 4096
    assert packing.pack(no_docs, WORDS).collect() == []


def test_one_labelled_id_on_many_rows_stays_bounded(spark):
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.labelled_sample(docs, labels, 5, 0, 100).count() == 100


def test_packing_deals_nameless_copies_over_groups(spark):
    docs = spark.range(9000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same few words").alias("text"))
    packed = packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), group_docs=1000)
    sizes = [r["count"] for r in packed.groupBy((F.col("sequence_id") / packing._BINS).cast("int").alias("g")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 1200 and sum(sizes) == 9000


def test_new_cuttings_encoded_together(monkeypatch):
    """Words, marks, figures, line ends and odd letters, more than go into one call, against the library on whole texts."""
    monkeypatch.setattr(tokens, "TOGETHER", 64)
    rng = np.random.default_rng(4)
    letters = ["a", "b", "é", "ß", "日", "ź", "​", "'s", "9", "½", "#", "...", "\n", "\t", "_", "ﷺ"]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(40)) for _ in range(60)]
    texts += ["", " lead", "tail ", "two  blanks", "x\x00y z", "<|endoftext|> <|endoftext|>a"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        bpe = tokens.Encoder(tokens.tokenizer_path(name), known=100)
        for _ in range(2):  # with and without what is remembered
            ids, lengths = bpe.encode(texts)
            for text, end, n in zip(texts, np.cumsum(lengths), lengths):
                assert ids[end - n : end].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_full_table_is_not_copied():
    """New cuttings are written behind what is remembered; a slice with few of them must not copy a table of many."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        bpe = tokens.Encoder(tokens.tokenizer_path(name), known=40)
        bpe.encode([" ".join(f"first{i}" for i in range(200))])
        starts, ids = bpe.starts, bpe.ids
        text = "other words, first3 \x85"
        found, lengths = bpe.encode([text[:-2], text, "", "first7\nfirst1"])
        want = [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in (text[:-2], text, "", "first7\nfirst1")]
        assert found.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
        assert bpe.starts is starts and bpe.ids is ids and len(bpe.known) == 40


def test_workers_keep_little(spark, monkeypatch):
    """A worker keeps one table, the texts stay on Spark's side of the quality score, and packed texts are unpacked bit by bit."""
    from pricewright.llm import common

    for known in (50, 60):
        tokens.encoder(tokens.tokenizer_path("word_bpe_49k.json"), known)
    assert len(common._remembered) == 1 and tokens.encoder(tokens.tokenizer_path("word_bpe_49k.json"), 60).most == 60

    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "a b", 7)], "doc_id long, text string, other int")
    rows = quality.scored(docs, quality.Model())
    assert rows.columns == ["doc_id", "text", "other", "quality_score"] and {r.quality_score for r in rows.collect()} == {0.5}
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(chosen_path, "SLICE", 8)
    texts = ["one two three", "", "four", "Five six", "x" * 50] * 3
    unpacked = []
    monkeypatch.setattr(chosen_path, "shingle_sets", lambda some, width, f=chosen_path.shingle_sets: unpacked.append(len(some)) or f(some, width))
    found = chosen_path._unpacked_sets(chosen_path._packed(texts), 2)
    first = next(found)
    assert unpacked == [1]
    want = [x.tolist() for x in chosen_path.shingle_sets(texts, 2)]
    assert [first.tolist(), *[x.tolist() for x in found]] == want
