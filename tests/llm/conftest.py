import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Columns that operators use inside, as extra columns of the input.
CLASHING = ("size", "digest", "kept", "chunk", "group", "score", "row", "path", "rep", "rate", "target", "held_out", "component", "times", "of", "a")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names used inside."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon", "en", "web"),
        (2, None, "en", "web"),
        (3, "", None, None),
        (4, " \t\n ", "de", "web"),
        (None, "no id here at all", "en", "web"),
        (None, None, None, None),
        (5, "Same text here for both of us", "en", "books"),
        (5, "Same text here for both of us", "en", "books"),
        (6, "SAME TEXT here for both of us", "en", "books"),
        (7, long_text, "de", "Books"),
        (8, long_text + " tail", "de", "Books"),
        (9, "123 456 ### 789", "en", "ü"),
        (10, "Ärger ÜBER alles, große Straße <|endoftext|>", "de", "ü"),
        (11, "x" * 5000, "en", "web"),
        (-4, "a negative id", "en", "web"),
    ]
    full = [(*r, len(r[1] or ""), *["clash"] * len(CLASHING)) for r in rows]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    types = ["bigint", "string", "string", "string", "bigint", *["string"] * len(CLASHING)]
    return spark.createDataFrame(full, ", ".join(f"`{n}` {t}" for n, t in zip(names, types))).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (6, 0, 0), (9, 0, 1), (10, None, 0), (99, 0, 0), (None, 1, 0), (1, 1, 0), (7, 7, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
