"""Reading the shared parquet tables.

Only ``spark.read.parquet``; column pruning and filter pushdown are left to
Catalyst (the physical scan shows ReadSchema/PushedFilters).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as scanned. A caller whose files have fewer splits than the
    cluster has cores may ask for a round-robin spread by setting
    ``spark.clausewise.scanPartitions`` (unset: none); it carries no key, so it
    never stands in for a shuffle that a query needs."""
    docs = table(spark, sf_dir, "documents")
    n = spark.conf.get("spark.clausewise.scanPartitions", None)
    return docs.repartition(int(n)) if n else docs


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
