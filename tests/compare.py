"""Compare a Spark result with what DuckDB makes of the checking SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DUCK_TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 9) + 0.0
    if isinstance(value, (pd.Timestamp, np.datetime64)):
        return str(value)[:10]
    if isinstance(value, np.generic):
        return value.item()
    return str(value) if hasattr(value, "isoformat") else value


def _rows(frame: pd.DataFrame) -> Counter:
    names = sorted(frame.columns)
    columns = [[_cell(v) for v in frame[n].tolist()] for n in names]
    return Counter(zip(*columns))


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, in words; empty when both results are the same."""
    found = []
    relation = con.sql(sql)
    duck_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    spark_types = dict(spark_df.dtypes)
    if set(duck_types) != set(spark_types):
        return [f"columns: spark {sorted(spark_types)}, sql {sorted(duck_types)}"]
    for name, kind in spark_types.items():
        if duck_types[name] != DUCK_TYPES.get(kind):
            found.append(f"type of {name}: spark {kind}, sql {duck_types[name]}")
    ours, theirs = _rows(spark_df.toPandas()), _rows(con.execute(sql).df())
    if sum(ours.values()) != sum(theirs.values()):
        found.append(f"rows: spark {sum(ours.values())}, sql {sum(theirs.values())}")
    if ours != theirs:
        extra, lacking = list((ours - theirs).elements()), list((theirs - ours).elements())
        found.append(f"{len(extra)} rows only in spark, e.g. {sorted(extra, key=repr)[:2]}; only in sql {sorted(lacking, key=repr)[:2]}")
    return found
