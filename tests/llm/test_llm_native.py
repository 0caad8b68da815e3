"""URL filter, exact dedup and source mix: checking SQL, hand-made cases, skew."""

import hashlib
from collections import Counter

import pytest
from compare import connect, differences
from plain import lower, mix_targets, words
from pyspark.sql import functions as F

from pricewright.llm import exact, mixing, queries, urls


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, small_dir, name):
    assert differences(queries.QUERIES[name](spark, small_dir), connect(small_dir), queries.SQL[name]) == []


# --- URL filter -------------------------------------------------------------------


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(list(queries.RULES), "host string, path string, verdict string")


def judged(spark, rules, addresses):
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id bigint, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("hits", F.lit(1))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}


def test_url_rules(spark, rules):
    cases = {
        "http://a.net/x?q=1": ("a.net", "/x", "net/", "block"),
        "https://Sub.Example.NET/en/1#top": ("sub.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/enx": ("example.net", "/enx", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://a.net?x=/": ("a.net", "", None, "allow"),
        "mailto:a.net/": ("", "", None, "allow"),
        "http:///net/": ("", "/net/", None, "allow"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://ÄB.org/FR/": ("Äb.org", "/FR/", None, "allow"),
        "http://a.net/" + "p" * 50_000: ("a.net", "/" + "p" * 50_000, "net/", "block"),
        "http://a.net/\nb": ("a.net", "/\nb", "net/", "block"),
        "x://y://a.net/": ("y:", "//a.net/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    addresses = list(cases) + ["http://a.net/x?q=1"]
    got = judged(spark, rules, addresses)
    assert [got[i] for i in range(len(addresses))] == [*cases.values(), cases["http://a.net/x?q=1"]]


def test_url_empty_list_and_table(spark, rules):
    assert judged(spark, rules.limit(0), ["http://a.net/"])[0] == ("a.net", "/", None, "allow")
    assert judged(spark, rules, [None]) == {0: ("", "", None, "allow")}
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(empty, rules).collect() == []


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    asked = spark.range(20_000).select("id", F.concat(F.lit("http://h"), F.col("id"), F.lit("/x")).alias("url"))
    got = urls.judge(asked, listed, key="id")
    assert got.where("verdict = 'block'").agg(F.count("*"), F.max("id")).first() == (3000, 2999)
    assert urls.filter_words(10**9) == urls.MAX_WORDS


# --- exact dedup ------------------------------------------------------------------


def test_exact_groups(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = Counter()
    for r in rows:
        ids = groups[lower(r.text)]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want[(r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(lower(r.text).encode()).hexdigest())] += 1
    for least in (1, 64):  # all digests by the broadcast, and all by the shuffle
        assert Counter(map(tuple, exact.groups(odd_docs, least=least).collect())) == want


def test_exact_hot_digests_and_sketch_size(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    want = docs.groupBy("text").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).count()
    got = exact.groups(docs, winners=4, tracked=16, least=10)
    assert got.where("kept").count() == want
    assert got.agg(F.max("group_size")).first()[0] == 1000


def test_exact_keep_one(odd_docs, no_docs):
    kept = exact.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id > 3) == [4, 6, 7, 8, 9, 10, 11]
    assert exact.groups(no_docs).collect() == [] and exact.keep_one(no_docs).collect() == []


def test_exact_keep_one_leaves_one_row_of_each_text(spark, odd_docs):
    """Null ids, ids with several texts, and repeated rows: the exact multiset of what stays."""
    rows = [
        (None, ""), (3, ""), (None, "alone"), (None, "twice"), (None, "TWICE"), (5, "a"), (5, "b"), (7, "A"),
        (8, "same"), (8, "same"), (9, "x"), (9, "x"), (2, "X"), (None, None),
    ]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in exact.keep_one(docs).collect())
    twice = (None, "TWICE") if got[(None, "TWICE")] else (None, "twice")
    assert got == Counter([(3, ""), (None, "alone"), twice, (5, "b"), (7, "A"), (8, "same"), (9, "x")])
    left = exact.keep_one(odd_docs).collect()
    assert Counter(lower(r.text) for r in left) == Counter({lower(r.text) for r in odd_docs.collect()})
    assert [r.text for r in left if r.doc_id is None] == ["no id here at all"]


# --- source mix -------------------------------------------------------------------


def test_mix_targets_and_sizes(odd_docs):
    rows = odd_docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for source in sorted({r.source for r in rows if r.source is not None}) + [None]:
        sizes[source] = sum(len(words(r.text)) for r in rows if r.source == source)
    target = mix_targets(sizes)
    got = mixing.taken_words(odd_docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, len(words(r.text))): r.source for r in rows}
    for r in got:
        source = by[(r.doc_id, r["size"])]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    rows = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = rows.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 6 and all(abs(r.taken - r.target) < 0.05 * r.target for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = mixing.taken_words(docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == again == sum(r.taken for r in got)


def test_mix_of_rows_without_ids_comes_near_its_targets(spark):
    docs = spark.range(6000).select(
        F.lit(None).cast("bigint").alias("doc_id"),
        F.concat(F.lit("w"), F.col("id")).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
    )
    taken = mixing.mix(docs).groupBy("source").count().collect()
    target = mix_targets({"s0": 2000, "s1": 2000, "s2": 2000})
    assert all(abs(r["count"] - target[r.source]) < 0.05 * target[r.source] for r in taken) and len(taken) == 3
    assert mixing.taken_words(docs).agg(F.sum("taken")).first()[0] == mixing.mix(docs).count()


def test_mix_of_nothing(odd_docs, no_docs):
    assert mixing.taken_words(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
    blank = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r.target, r.taken) for r in mixing.taken_words(blank).collect()} == {(0, 0.0, 0)}
