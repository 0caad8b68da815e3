"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}
_CTES: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Register a function under its own name; ``ids`` are the inventory lines it covers."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        SURVEY_IDS[fn.__name__] = ids
        if sql is not None:
            SQL[fn.__name__] = with_ctes(sql)
        return fn

    return add


def cte(name: str, text: str) -> None:
    """Define a common table expression that queries may name."""
    _CTES[name] = text.strip()


def with_ctes(body: str) -> str:
    """Put the common table expressions ``body`` names, and those they name, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    if not needed:
        return body.strip()
    parts = [f"{name} AS MATERIALIZED ({_CTES[name]})" for name in _CTES if name in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S)
    if own:
        return f"WITH {own.group(1) or ''}" + ",\n".join(parts) + ",\n" + own.group(2).strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
