"""Reading raw retail transactions."""

from __future__ import annotations

import csv
import re
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.clean import REQUIRED

# Header spellings of the same column.
HEADER_VARIANTS = {"UnitPrice": "Price", "Unitprice": "Price", "InvoiceNo": "Invoice"}
# What a path pattern would read as more than itself.
_GLOB = re.compile(r"[\\{}\[\]*?]")


def normalised_names(header) -> list[str]:
    """Header names trimmed, without blanks inside, in one spelling.

    Two that end up the same are an error, not a silent pick.
    """
    names = [HEADER_VARIANTS.get(c, c) for c in (name.strip().replace(" ", "") for name in header)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several headers mean the same column: {', '.join(twice)}")
    return names


def normalise_headers(df: DataFrame) -> DataFrame:
    """The same columns under their normalised names."""
    return df.toDF(*normalised_names(df.columns))


def _first_line(spark: SparkSession, uri: str, encoding: str) -> tuple[str, str]:
    """Path of a file and its first line, read through whatever storage it lies on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
    try:
        return path.toString(), lines.readLine() or ""
    finally:
        lines.close()


def header_plan(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """Headers among the files of ``paths``, each with its files; an empty file has none.

    Only the first line of each file is read, a few files at a time.
    """
    uris = spark.read.text(paths).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda uri: _first_line(spark, uri, encoding), uris))
    plan: dict[tuple[str, ...], list[str]] = {}
    for path, line in sorted(found):
        header = tuple(next(csv.reader([line.removeprefix("\ufeff")]), ()))
        if any(name.strip() for name in header):
            plan.setdefault(header, []).append(path)
    return plan


def read_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Retail CSV with every column as text; numbers and dates are coerced when cleaning.

    Files may have their columns in any order and under any of the known names: those that share a header are
    read in one scan, and the scans are united by name.  A column that a file lacks is null there, but one
    that transactions need is an error.  Undecodable bytes and damaged rows do not stop the read.
    """
    plan = header_plan(spark, paths, encoding)
    if not plan:
        raise ValueError(f"no header in {paths}")
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding)
    scans = []
    for header, files in plan.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        # With one header the paths are read as they were given, however many files they hold.
        own = paths if len(plan) == 1 else [_GLOB.sub(r"\\\g<0>", f) for f in files]
        scans.append(_named(reader.schema(schema).csv(own), header, files))
    known = set().union(*[scan.columns for scan in scans])
    for scan, files in zip(scans, plan.values()):
        lacking = [c for c in REQUIRED if c in known and c not in scan.columns]
        if lacking:
            raise ValueError(f"{files[0]} lacks {', '.join(lacking)}, which other files have")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _named(df: DataFrame, header: tuple[str, ...], files: list[str]) -> DataFrame:
    try:
        return df.toDF(*normalised_names(header))
    except ValueError as error:
        raise ValueError(f"{files[0]}: {error}") from None


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    return normalise_headers(spark.read.parquet(*paths))


def first_readable(spark: SparkSession, candidates: list[str], read=read_csv) -> DataFrame | None:
    """The first candidate that can be read, or ``None``.

    Reading is lazy, so one row is asked for to see whether it works.
    """
    for path in candidates:
        try:
            df = read(spark, path)
            df.limit(1).collect()
            return df
        except Exception as error:  # any failure means: try the next source
            warnings.warn(f"cannot read {path}: {type(error).__name__}", stacklevel=2)
    return None
