"""URL filter: a blocked Bloom filter before an exact hash join.

The list holds canonical URLs as (host, path, verdict).  An entry fits a URL whose host is
the entry's or a subdomain of it and whose path starts with the entry's; the longest fitting
entry decides.  A URL is therefore expanded into its host's suffixes and its path's
prefixes, but only of the lengths the list has.  These keys are first tested in the Bloom filter, an array
of 64-bit words in which a key's bits all lie in one block of eight words.  URLs without a possible hit, which is nearly all
when the list is selective, pass without any shuffle.  The rest are joined with the list, which removes
false positives.

Defined results: a null URL, or one without ``://``, has an empty host and path; nothing fits it
and it gets the default verdict; repeated rows give repeated rows; two entries for the same
host and path count as ``block``; an empty list or table gives default verdicts or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

BLOCK_WORDS = 8
PROBES = 6
MAX_WORDS = 1 << 17  # 1 MiB: the bound of the filter that every task gets


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the filter sees them."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    end = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.when(known, lower_ascii(end)).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)).otherwise("")
    return host, path


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words // BLOCK_WORDS)) * BLOCK_WORDS


def _places(key: Column, words: int) -> list[tuple[Column, Column]]:
    """Word and bit mask of each probe; all words of a key are in one block."""
    bits = F.xxhash64(key, F.lit(1))
    first = _word(key, words)
    out = []
    for i in range(PROBES):
        nine = F.shiftrightunsigned(bits, 9 * i).bitwiseAND(F.lit(511))
        word = (first + F.shiftrightunsigned(nine, 6)).cast("int")
        out.append((word, F.call_function("shiftleft", F.lit(1).cast("bigint"), nine.bitwiseAND(F.lit(63)).cast("int"))))
    return out


def filter_words(entries: int) -> int:
    """About 32 bits an entry, as a power of two, up to the bound."""
    words = BLOCK_WORDS * 16
    while words < MAX_WORDS and words * 2 < entries:
        words *= 2
    return words


def bloom(listed: DataFrame, words: int) -> DataFrame:
    """One row with the filter as an array of ``words`` 64-bit words."""
    key = _key(F.col("host"), F.col("path"))
    probes = F.array(*[F.struct(w.alias("word"), mask.alias("mask")) for w, mask in _places(key, words)])
    filled = (
        listed.select(F.explode(probes).alias("p"))
        .groupBy("p.word")
        .agg(F.bit_or("p.mask").alias("mask"))
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("filled"))
    )
    return filled.select(
        F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.col("filled")[i], F.lit(0).cast("bigint"))).alias("words")
    )


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys of a URL that may be listed: host suffixes of ``labels`` labels, path prefixes of ``lengths`` characters."""
    n_labels = F.size(F.split(host, r"\."))
    keys = []
    for k in labels:
        suffix = F.substring_index(host, ".", -k)
        for n in lengths:
            fits = (host != "") & (n_labels >= k) & (F.char_length(path) >= n)
            keys.append(F.when(fits, F.struct(suffix.alias("host"), F.substring(path, 1, n).alias("path"))))
    return F.filter(F.array(*keys), lambda x: x.isNotNull()) if keys else F.expr("array()")


def judge(urls: DataFrame, listed: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per URL: ``key, host, path, rule, verdict``.

    ``urls`` has the columns ``key`` and ``url``; ``listed`` has ``host, path, verdict``.
    """
    spark = urls.sparkSession
    entries = written(
        listed.groupBy("host", "path").agg(F.max("verdict").alias("listed_verdict")), "url-list"
    )
    # One row: the numbers of labels and path lengths that occur, and the number of entries.
    seen = entries.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    words = filter_words(seen.n)
    host, path = split_url(F.col("url"))
    # Written once: all that follows reads host and path as plain columns, and no page is parsed twice.
    pages = written(urls.select(F.col(key).alias(key), host.alias("host"), path.alias("path")), "url-parts")
    if not seen.n:
        return pages.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # One row of at most 1 MiB, put into the plan as one literal that all tasks share.
    bits = bloom(entries, words).first().words
    shared_words = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def possible(c: Column) -> Column:
        test = F.lit(True)
        for word, mask in _places(_key(c["host"], c["path"]), words):
            test = test & (F.get(shared_words, word).bitwiseAND(mask) != 0)
        return test

    keys = candidates(F.col("host"), F.col("path"), sorted(seen.labels), sorted(seen.lengths))
    tested = pages.select(key, "host", "path", F.filter(keys, possible).alias("hits"))
    passed = tested.where(F.size("hits") == 0).select(
        key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
    )
    asked = tested.where(F.size("hits") > 0)
    # A verdict depends on host and path alone, so each pair is looked up once.
    pairs = asked.groupBy("host", "path").agg(F.first("hits").alias("hits"))
    fitting = (
        pairs.select("host", "path", F.explode("hits").alias("hit"))
        .join(entries.select(F.struct("host", "path").alias("hit"), "listed_verdict"), "hit")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.char_length("hit.host") + F.char_length("hit.path")).alias("long"),
                    F.concat("hit.host", "hit.path").alias("rule"),
                    F.col("listed_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    judged = asked.select(key, "host", "path").join(fitting, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return passed.unionByName(judged)
