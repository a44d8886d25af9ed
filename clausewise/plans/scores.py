"""Score tables for decoding, derived from ``embeddings``.

``vec_id`` stands for the clause, ``label`` for the document; elements 1 and 2
form the two-output score (bow, tfm); ``(e1 + 1) / 2`` is the one-output
probability (bert).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.aggregates import class_counts, with_ratios
from clausewise.operators.decode import MODES, decode, decode_columns
from clausewise.sources import tables


def score_table(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    e1 = F.element_at("embedding", 1).cast("double")
    e2 = F.element_at("embedding", 2).cast("double")
    score = F.array((e1 + F.lit(1.0)) / F.lit(2.0)) if mode == "bert" else F.array(e1, e2)
    return e.select(F.col("label").cast("long").alias("doc_id"),
                    F.col("vec_id").alias("clause_no"),
                    F.lit(mode).alias("mode"), score.alias("score"))


def decoded(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return decode(score_table(spark, sf_dir, mode), mode).select(
        "doc_id", "clause_no", "class", "decode_error")


def decoded_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three modes from ONE scan: a row per (mode, clause), decoded by mode."""
    e = tables.embeddings(spark, sf_dir)
    e1 = F.element_at("embedding", 1).cast("double")
    e2 = F.element_at("embedding", 2).cast("double")
    per_mode = {"bow": F.array(e1, e2), "bert": F.array((e1 + F.lit(1.0)) / F.lit(2.0)),
                "tfm": F.array(e1, e2)}
    rows = e.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("clause_no"),
                    F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), per_mode[m].alias("score"))
                                       for m in MODES])))
    cls, err = None, None
    for m in MODES:
        c, r = decode_columns(F.col("score"), m)
        cls = F.when(F.col("mode") == m, c) if cls is None else cls.when(F.col("mode") == m, c)
        err = F.when(F.col("mode") == m, r) if err is None else err.when(F.col("mode") == m, r)
    return rows.withColumn("class", cls).withColumn("decode_error", err)


def doc_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(decoded_all_modes(spark, sf_dir), ["mode", "doc_id"])


def doc_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ratios(doc_class_counts(spark, sf_dir))
