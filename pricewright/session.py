"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "pricewright", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, leave ``master`` unset and let spark-submit provide it; the
    number of shuffle partitions is then whatever the cluster configures.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if cpus:
        builder = builder.config("spark.sql.shuffle.partitions", str(cpus))
        builder = builder.config("spark.driver.memory", os.environ.get("PRICEWRIGHT_DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session may go without that setting; it then gets a fresh local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="pricewright-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return (named or current).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` to the shared folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def write_once(df, label: str):
    """Write ``df`` as parquet to the shared folder and go on from the files.

    Unlike a checkpoint this keeps columns apart and tells Spark the size.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A task that sorts and gathers rows several times over gets about this many.
ROWS_PER_TASK = 200_000


def tasks_for(df, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks to deal the rows of ``df`` over, so that none gets more of them as the input grows.

    Of a table in files only the stored counts are read.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def reads_files(df) -> bool:
    """Whether ``df`` only picks columns of files, so that reading it again costs no more than a copy."""
    kinds = [line.strip(" :+-*").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    return all(kind in ("Project", "Relation") for kind in kinds)
