"""Labelled-corpus queries: tokens and label encodings (O-10, O-25..O-27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.labels import argmax, encode_first_seen, encode_fixed, one_hot
from clausewise.operators.segment import tokenise
from clausewise.sources import corpus


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(corpus.clauses(spark, sf_dir), keep=("doc_id", "clause_no"))


def first_seen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = corpus.labelled_clauses(spark, sf_dir).drop("clause")
    return encode_first_seen(lab, scope=["persona"], order=["doc_id", "clause_no"]).select(
        "persona", "doc_id", "clause_no", "class", "label", "encode_error")


def fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = corpus.labelled_clauses(spark, sf_dir)
    return lab.select("persona", "doc_id", "clause_no", encode_fixed(F.col("class")).alias("label"))


def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixed_labels(spark, sf_dir)
    return (f.withColumn("one_hot", one_hot(F.col("label")))
             .withColumn("argmax", argmax(F.col("one_hot"))))
