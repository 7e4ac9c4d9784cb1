"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing the shuffle files of a finished execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def qualified(spark: SparkSession, where: str) -> str:
    """`where` with the scheme and host that Spark's default file system gives it, as a URI that others read alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI. Where it is unset, a temporary folder for a local master; on a cluster that is
    an error, as every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found.rstrip("/"))


_scopes: list[list[Scratch]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end all scratch tables that were opened in it. What is read later must have been written elsewhere."""
    opened: list[Scratch] = []
    _scopes.append(opened)
    try:
        yield
    finally:
        _scopes.remove(opened)
        for scratch in opened:
            scratch.drop()


class Scratch:
    """Tables under the shared folder that cut lineage: every executor can read them again after a loss."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for opened in _scopes:
            opened.append(self)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """`df`, written and read again. Its shuffle files go when it is written: nothing reads them any more."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again; without names, all."""
        jvm = self.spark._jvm
        for where in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
