"""Product catalogue and series on storage."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reads_files, write_once
from . import versions

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("base_price", T.DoubleType()),
        T.StructField("elasticity", T.DoubleType()),
        T.StructField("base_demand", T.DoubleType()),
        T.StructField("price_min", T.DoubleType()),
        T.StructField("price_max", T.DoubleType()),
        T.StructField("noise_std", T.DoubleType()),
        T.StructField("timeseries_file", T.StringType()),
        T.StructField("is_custom", T.BooleanType()),
        T.StructField("position", T.LongType()),
    ]
)

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("day_of_year", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("demand", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("seasonal", T.DoubleType()),
    ]
)

# Defaults of missing catalogue fields, and file names of the layout.
DEFAULT_NOISE_STD = 0.10
DEFAULT_CATEGORY = "physical_good"
CATALOGUE_DIR = "products_metadata.json"
SERIES_DIR = "series"
SERIES_SUFFIX = "_timeseries.csv"
_FILE = "file"
# File names that need no escape in a path and are not hidden.
_PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
# A hash folder holds about this many rows.
ROWS_PER_BUCKET = 1_000_000
# Rows of a page: the calendar of a product repeats itself, which shows only in pages that hold many of them.
ROWS_PER_PAGE = 200_000


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever storage its scheme names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Catalogue from a JSON array (or JSON lines with ``multi_line=False``), ids as text."""
    raw = spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", multi_line).json(path)
    return (
        raw.withColumnRenamed("id", "product_id")
        .withColumn("noise_std", F.coalesce("noise_std", F.lit(DEFAULT_NOISE_STD)))
        .withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))
    )


def _decoded(part: Column) -> Column:
    """Part of a path without percent escapes; a plus in it is a plus, not a blank."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def read_series_csv(spark: SparkSession, directory: str) -> DataFrame:
    """All ``<id>_timeseries.csv`` of a folder in one scan, the id taken from that name.

    Each may be a file, or a folder that ``write_series_csv`` makes of a product.
    """
    raw = (
        spark.read.schema(SERIES_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(directory)
    )
    # The path comes percent-encoded.  Folder names were escaped once more when written.  All this runs on every row, so it
    # looks at the path's end first and has no regular expression.
    path, end = F.col("_metadata.file_path"), len(SERIES_SUFFIX)
    file = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    named = path.contains(f"/{_FILE}=") & folder.startswith(f"{_FILE}=") & folder.endswith(SERIES_SUFFIX)
    by_folder = named & (F.length(folder) > len(_FILE) + 1 + end)
    by_file = path.endswith(SERIES_SUFFIX) & ~path.endswith(f"/{SERIES_SUFFIX}")
    of_folder = F.substr(folder, F.lit(len(_FILE) + 2), F.length(folder) - (len(_FILE) + 1 + end))
    of_file = F.left(file, F.length(file) - end)
    own = F.when(by_folder, _decoded(_decoded(of_folder))).when(path.contains("%"), _decoded(of_file)).otherwise(of_file)
    return raw.filter(by_file | by_folder).select(own.alias("product_id"), "*")


def find_series_csv(spark: SparkSession, directory: str, product_id) -> DataFrame:
    """Series of one product among ``<id>_timeseries.csv``; no other product's file is read."""
    name = f"{product_id}{SERIES_SUFFIX}"
    reader = spark.read.option("header", True)
    if path_exists(spark, f"{directory}/{name}"):
        exact = re.sub(r"[\\{}\[\]*?]", r"\\\g<0>", f"{directory}/{name}")
        return reader.schema(SERIES_SCHEMA).csv(exact)
    if not path_exists(spark, f"{directory}/{_folder_of(name)}"):
        return spark.createDataFrame([], SERIES_SCHEMA)
    schema = T.StructType([*SERIES_SCHEMA.fields, T.StructField(_FILE, T.StringType())])
    return reader.schema(schema).csv(directory).filter(F.col(_FILE) == name).drop(_FILE)


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path as tasks open it, if the shared folder is mounted as files; None on any other storage."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    storage = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return storage.makeQualified(target).toUri().getPath() if storage.getUri().getScheme() == "file" else None


def _folder_of(name: str | None) -> str:
    """The folder of a file name as Spark's writer calls it."""
    escaped = "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in name or "")
    return f"{_FILE}={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def _put_files(directory: str, header: str):
    """A function for ``mapInArrow`` that puts lines, sorted by file name, into files of these names and returns the names.

    A file is written under a hidden name and then renamed, so a task that runs again leaves the same files.
    """

    def put(batches):
        attempt = TaskContext.get().taskAttemptId()
        at = name = out = None

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, at)

        for batch in batches:
            names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            begun = []
            for start, end in zip(starts, [*starts[1:], len(names)]):
                if out is None or names[start] != name:
                    close()
                    name = names[start]
                    begun.append(name)
                    at = f"{directory}/{name}"
                    if name is None or not _PLAIN.fullmatch(name):
                        at = f"{directory}/{_folder_of(name)}/part-0.csv"
                        os.makedirs(os.path.dirname(at), exist_ok=True)
                    out = open(f"{os.path.dirname(at)}/.{attempt}", "w", encoding="utf-8", newline="")
                    out.write(f"{header}\n")
                out.writelines(f"{line}\n" for line in lines[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(begun, pa.string())], ["file"])
        close()

    return put


def write_series_csv(series: DataFrame, directory: str) -> None:
    """Series as CSV named ``<id>_timeseries.csv``, one file per product, for readers that go by file name.

    Rows are dealt by product, and the tasks put the lines Spark makes of them straight into the files.  Names that do not go
    without escapes are those of a folder with the file in it; so are all of them on storage that is not mounted as files.
    There Spark writes, which costs a folder to make, to move and to list for each product.
    """
    spark = series.sparkSession
    name = F.concat(F.col("product_id"), F.lit(SERIES_SUFFIX))
    shown = [F.date_format("date", "yyyy-MM-dd").alias("date") if c == "date" else F.col(c) for c in SERIES_SCHEMA.names]
    rows = series.select(name.alias(_FILE), *shown).repartition(_FILE).sortWithinPartitions(_FILE, "date")
    local = _local_path(spark, directory)
    if local is None:
        rows.write.partitionBy(_FILE).option("header", True).csv(directory)
        return
    if path_exists(spark, directory):
        raise FileExistsError(f"{directory} exists already")
    os.makedirs(local)
    lines = rows.select(_FILE, F.to_csv(F.struct(*SERIES_SCHEMA.names)).alias("line"))
    lines.mapInArrow(_put_files(local, ",".join(SERIES_SCHEMA.names)), "file string").count()


def _check_series(catalogue: DataFrame, known: DataFrame, strict: bool) -> None:
    """Raise, or warn, if a product of the catalogue is not among the known ids."""
    missing = catalogue.join(known, "product_id", "left_anti")
    examples = [r["product_id"] for r in missing.select("product_id").limit(5).collect()]
    if examples and strict:
        raise FileNotFoundError(f"no series for products such as {', '.join(examples)}")
    if examples:
        warnings.warn(f"products without series are left out, such as {', '.join(examples)}", stacklevel=3)


def attach_series(catalogue: DataFrame, series: DataFrame, strict: bool = True) -> DataFrame:
    """Catalogue joined to series.

    Strict loading fails when a product has no series; lenient loading warns and
    goes on without the product.  Series read by file name are written once in columns, as check and join both
    read them, and a file per product is costly to open.
    """
    if not reads_files(series):
        series = write_once(series, "attached-series")
    _check_series(catalogue, series.select("product_id").distinct(), strict)
    return series.join(catalogue, "product_id")


def _bucket(product_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(product_id), F.lit(buckets)).cast("int")


def _same(a: Column, b: Column) -> Column:
    """Whether two figures are one double; zeros have two spellings and are never taken as the same."""
    return F.coalesce((a == b) & (a != 0), F.lit(False))


def _packed(series: DataFrame, seasonal: bool) -> DataFrame:
    """Series as stored: a figure that a product of two others gives bit by bit is not stored beside them.

    ``own_revenue`` is there unless ``priced_revenue`` says that price times demand is the revenue.  Demand that goes with the
    season, as it does in ``seasonal`` series, is stored as ``demand_ratio`` to it, which hardly changes; the others
    have ``own_demand``.  Each product is worked out here and compared, so no value is ever lost.
    """
    demand, season, revenue = F.col("demand"), F.col("seasonal"), F.col("revenue")
    ratio = F.lit(None).cast("double")
    if seasonal:
        quotient = F.try_divide(demand, season)
        ratio = F.when(_same(quotient * season, demand), quotient)
    rows = series.withColumn("demand_ratio", ratio).withColumn("priced_revenue", _same(F.col("price") * demand, revenue))
    return rows.select(
        *["product_id", "date", "day_of_week", "day_of_year", "price", "seasonal", "demand_ratio", "priced_revenue"],
        F.when(F.col("demand_ratio").isNull(), demand).alias("own_demand"),
        F.when(~F.col("priced_revenue"), revenue).alias("own_revenue"),
    )


def _unpacked(stored: DataFrame) -> DataFrame:
    """Series with all their columns from what ``_packed`` stores, or from a version that holds them plainly."""
    if "priced_revenue" not in stored.columns:
        return stored.drop("bucket")
    ratio = F.col("demand_ratio")
    demand = F.when(ratio.isNotNull(), ratio * F.col("seasonal")).otherwise(F.col("own_demand"))
    revenue = F.when(F.col("priced_revenue"), F.col("price") * demand).otherwise(F.col("own_revenue"))
    made = {"demand": demand, "revenue": revenue}
    return stored.select("product_id", *[made.get(c, F.col(c)).alias(c) for c in SERIES_SCHEMA.names])


def save_products(
    catalogue: DataFrame, series: DataFrame, directory: str, buckets: int | None = None, unfolded: tuple[DataFrame, Callable] | None = None
) -> dict:
    """Write catalogue and series as a new version of the dataset and return its manifest.

    One folder per product would mean as many folders as products, so series are
    laid out in hash folders, sorted by product and date inside; a lookup prunes by folder and
    by parquet statistics.  Their number follows the number of rows unless it is given, and is stored
    in the manifest, which is written last.  A product has a row per day at most, so no folder is hot.
    Every day has its row there, with demand and revenue as ``_packed`` stores them.

    ``unfolded`` are products whose series a function of them makes row by row: the products are dealt over the folders
    and their days made there, so that these are never shuffled, and a task sorts about one folder.
    """
    spark = series.sparkSession

    def lay_out(days: DataFrame, used: int, seasonal: bool = False) -> DataFrame:
        return _packed(days, seasonal).withColumn("bucket", _bucket(F.col("product_id"), used))

    def put(days: DataFrame, folder: str) -> None:
        in_order = days.sortWithinPartitions("bucket", "product_id", "date")
        writer = in_order.write.mode("append").partitionBy("bucket").option("compression", "zstd")
        writer.option("parquet.page.row.count.limit", ROWS_PER_PAGE).parquet(f"{folder}/{SERIES_DIR}")

    def write(folder: str) -> dict:
        products, unfold = unfolded or (None, None)
        rows = series.count() + (unfold(products).count() if unfolded else 0)
        used = max(1, -(-rows // ROWS_PER_BUCKET)) if buckets is None else buckets
        put(lay_out(series, used).repartition("bucket"), folder)
        if unfolded:
            dealt = products.repartitionByRange(used, _bucket(F.col("product_id"), used))
            put(lay_out(unfold(dealt), used, seasonal=True), folder)
        at = F.concat(F.lit(f"{folder}/{SERIES_DIR}/bucket="), _bucket(F.col("product_id"), used).cast("string"))
        listed = catalogue.withColumn("timeseries_file", at).withColumnRenamed("product_id", "id")
        listed.write.option("compression", "gzip").json(f"{folder}/{CATALOGUE_DIR}")
        return {"buckets": used, "rows": rows}

    return versions.commit(spark, directory, write)


def _current_folder(spark: SparkSession, directory: str) -> tuple[str, dict]:
    manifest = versions.current(spark, directory)
    if manifest is None:
        raise FileNotFoundError(f"no committed dataset in {directory}")
    return f"{directory}/{manifest['folder']}", manifest


def load_products(spark: SparkSession, directory: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Catalogue and series of a folder; the series only of listed products.

    Reads the current version of what ``save_products`` writes, and also a folder with one JSON array and one
    CSV series per product.
    """
    if versions.current(spark, directory) is not None:
        folder, _ = _current_folder(spark, directory)
        catalogue = read_catalogue(spark, f"{folder}/{CATALOGUE_DIR}", multi_line=False)
        series = _unpacked(spark.read.parquet(f"{folder}/{SERIES_DIR}"))
    else:
        catalogue = read_catalogue(spark, f"{directory}/{CATALOGUE_DIR}")
        series = write_once(read_series_csv(spark, directory), "series-by-file")
    known = write_once(series.select("product_id").distinct(), "known-products")
    _check_series(catalogue, known, strict)
    if not strict:
        catalogue = catalogue.join(known, "product_id", "left_semi")
    if known.join(catalogue.select("product_id"), "product_id", "left_anti").isEmpty():
        return catalogue, series  # nothing to leave out, so no join that would shuffle every day
    return catalogue, series.join(catalogue.select("product_id"), "product_id", "left_semi")


def find_series(spark: SparkSession, directory: str, product_id) -> DataFrame:
    """Series of one product; reads only the folder its id hashes to, as the manifest says."""
    folder, manifest = _current_folder(spark, directory)
    series = spark.read.parquet(f"{folder}/{SERIES_DIR}")
    wanted = F.lit(str(product_id))
    return _unpacked(series.filter((F.col("bucket") == _bucket(wanted, manifest["buckets"])) & (F.col("product_id") == wanted)))


def is_complete(spark: SparkSession, directory: str) -> bool:
    """Whether ``directory`` holds a whole dataset: a committed version, or a catalogue file with a series per product."""
    return versions.current(spark, directory) is not None or path_exists(spark, f"{directory}/{CATALOGUE_DIR}")


def get_products(
    spark: SparkSession, directory: str, build: Callable[[], tuple[DataFrame, DataFrame]]
) -> tuple[DataFrame, DataFrame]:
    """Reuse the dataset in ``directory`` if it is there, else build and save it."""
    if not is_complete(spark, directory):
        catalogue, series = build()
        save_products(catalogue, series, directory)
    return load_products(spark, directory)
