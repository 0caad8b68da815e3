"""The registered queries of this subpackage, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import chosen_path, conversations, elias_fano, embeddings, exact, language, licenses, mixing, negatives, packing, ppm, quality, urls
from .common import table
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Fixed by the contract of the query: host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    rf"""
WITH rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
split AS (
    SELECT row_number() OVER () AS n, page_id,
           CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
           CASE WHEN contains(url, '://') THEN regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) ELSE '' END AS path
    FROM (SELECT *, substr(url, instr(url, '://') + 3) AS rest FROM pages)),
fitting AS (
    SELECT n, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
           max_by(r.verdict, length(r.host || r.path)) AS verdict
    FROM split s JOIN rules r
      ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
    GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fitting USING (n)
"""
)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL; what no rule fits is allowed."""
    listed = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), listed)


@query(
    f"""
WITH hashed AS (
    SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact.groups(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name
    FROM documents),
per AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sizes GROUP BY source),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM per),
walk AS (
    SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
           coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before
    FROM weighed
    WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, weight * (total - caps_before) >= cap * (weights - weights_before) AS is_full FROM walk),
goals AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN cap::DOUBLE
                ELSE (weight * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)))::DOUBLE
                     / (weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0))::DOUBLE END AS target
    FROM filled),
rated AS (
    SELECT d.doc_id, d.size, g.source_size, g.target,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('7:' || name), 1, 13))::BIGINT::DOUBLE
               / 4503599627370496.0::DOUBLE AS draw
    FROM sizes d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query()
def op8_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all texts as shards and read every document's span back from them."""
    folder = fresh_path(spark, "token-shards")
    elias_fano.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return elias_fano.read(spark, folder)


@query()
def op9_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in its sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), known=800_000)


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from labelled rows that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a
    JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
    WHERE list_inner_product(a.vec, b.vec)
          >= 0.93::DOUBLE * sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN degrees d ON d.a = vec_id LEFT JOIN least_of c ON c.a = vec_id
"""
)
def op3_hamming_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.duplicates(table(spark, sf_dir, "embeddings"))


@query(
    rf"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
held AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                      ELSE w END) AS shingles
    FROM cut),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM held),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
       doc_id <= coalesce(b, doc_id) AS kept
FROM held LEFT JOIN least_of ON a = doc_id
"""
)
def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every whole text, by pairs of words."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text, learned from the rows that are not held out."""
    return ppm.score(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
bits(conv_id, step, crc) AS (
    SELECT conv_id, 0, 4294967295::BIGINT FROM ids
    UNION ALL
    SELECT conv_id, step + 1,
           CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(substr(conv_id::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE crc END AS x
          FROM bits WHERE step < 8 * length(conv_id::VARCHAR))),
heads AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 4 AS h FROM bits WHERE step = 8 * length(conv_id::VARCHAR)),
turned AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
moved AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads c JOIN turned t
      ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.role, t.text FROM heads c JOIN turned t ON t.conv_id = c.conv_id AND t.pos > c.h),
steps AS (
    SELECT conv_id, row_number() OVER w AS d, text,
           list({'role': role, 'text': text}) OVER w AS key
    FROM moved WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
paths AS (
    SELECT conv_id, d, key::VARCHAR AS key, text FROM steps
    UNION ALL SELECT conv_id, 0, '', '' FROM heads),
lens AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (
    SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256,
           (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved
    FROM paths JOIN lens USING (conv_id) GROUP BY d, key),
placed AS (
    SELECT n.*, p.key AS parent_key, m.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1
    LEFT JOIN nodes m ON m.d = p.d AND m.key = p.key),
kids AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS n_children FROM placed WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT p.d, p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (k.key IS NULL) AS n_leaves
    FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.key = n.key
    JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key)
SELECT n.conv_id, n.d::BIGINT AS depth, n.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM placed n JOIN below b USING (d, key) LEFT JOIN kids k USING (d, key)
"""
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node of every prefix of the rebuilt conversations."""
    return conversations.prefix_nodes(table(spark, sf_dir, "conversations"))


@query()
def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every whole text."""
    return licenses.summary(licenses.detections(table(spark, sf_dir, "documents")))


@query(
    """
WITH vectors AS (
    SELECT row_number() OVER () AS n, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = o.label AS alike, o.vec_id, list_inner_product(a.vec, o.vec)::BIGINT AS score
    FROM vectors a JOIN vectors o ON a.n <> o.n WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
)
def op13_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, for each of its positives."""
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)
