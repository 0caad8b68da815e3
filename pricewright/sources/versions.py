"""Versions of a dataset under one manifest.

A build writes a folder of its own and commits by putting a numbered manifest last.  Readers resolve the newest manifest
once and read only the folder it names, so they never see half a build or files of two builds.  Two builds at a
time get two numbers; neither overwrites the other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFESTS = "manifests"
VERSIONS = "versions"


def _files(spark: SparkSession, path: str):
    """Hadoop's view of ``path`` and the storage it lies on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, directory: str) -> list[int]:
    folder, storage = _files(spark, f"{directory}/{MANIFESTS}")
    if not storage.exists(folder):
        return []
    names = [status.getPath().getName() for status in storage.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, directory: str, number: int) -> dict:
    path, storage = _files(spark, f"{directory}/{MANIFESTS}/{number:012d}.json")
    stream = storage.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, directory: str) -> dict | None:
    """The newest manifest, or ``None`` before the first commit."""
    numbers = _numbers(spark, directory)
    return _manifest(spark, directory, numbers[-1]) if numbers else None


def commit(spark: SparkSession, directory: str, write: Callable[[str], dict]) -> dict:
    """Let ``write`` fill a new folder, then make that folder the current version.

    What ``write`` returns is stored in the manifest.  If it fails, the version before it stays current.
    """
    folder = f"{VERSIONS}/{uuid.uuid4().hex}"
    facts = write(f"{directory}/{folder}")
    draft, storage = _files(spark, f"{directory}/{MANIFESTS}/{uuid.uuid4().hex}.draft")
    number = (_numbers(spark, directory) or [0])[-1] + 1
    while True:
        manifest = {**facts, "number": number, "folder": folder}
        stream = storage.create(draft, True)
        stream.write(json.dumps(manifest, sort_keys=True).encode())
        stream.close()
        target, _ = _files(spark, f"{directory}/{MANIFESTS}/{number:012d}.json")
        # A manifest appears whole or not at all; a number another build has taken is left to it.
        if not storage.exists(target) and storage.rename(draft, target):
            return manifest
        number += 1


def prune(spark: SparkSession, directory: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions, manifests first; how many went."""
    gone = _numbers(spark, directory)[: -max(1, keep)]
    for number in gone:
        manifest = _manifest(spark, directory, number)
        for path in (f"{MANIFESTS}/{number:012d}.json", manifest["folder"]):
            target, storage = _files(spark, f"{directory}/{path}")
            storage.delete(target, True)
    return len(gone)
