"""Session construction and shared-folder helpers.

Library functions never create sessions; they take DataFrames. This module is
for entry points (bench, tests, command-line use) that need one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "clausewise", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small-in-bytes shuffles here are often CPU-heavy (substring and term
        # expansion); let AQE keep more than one task per MB of shuffle data
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    On a cluster it must be set (a file system all executors share); a folder
    of one machine would be a different disk for every executor, so an unset
    value is an error there. Only a session that runs in one process (master
    ``local[..]``: tests, bench) gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clausewise-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries run inside go when each of them ends, not at some later
    garbage collection of the driver. For queries that are run once, such as a write."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


_STAGES: list[str] = []  # folders this process has staged and not released


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: computed once,
    prunable by column, and safe from lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGES.append(path)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> int:
    """Removes the stages written so far and returns their number. Only for a caller
    who has finished with every DataFrame built on them (they are read lazily)."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, done = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _STAGES:
        path = paths.Path(_STAGES.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
