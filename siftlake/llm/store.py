"""Tables that cut lineage, kept in the folder that the whole cluster shares.

The folder is ``spark.checkpoint.dir``; only where that is unset (tests, a notebook) a folder of our own is chosen.
A table written here survives the loss of any executor, and its size on disk tells the planner how to join it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "siftlake")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, so a job of several steps needs the disk of one."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written. ``df`` is not to be run again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files behind a stashed table that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
