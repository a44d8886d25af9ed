"""O-22..O-24: evaluation of a scorer against labelled clauses.

Rows: the held-out clauses (``split = 'test'`` of the exact hash-ordered split,
per persona) of labelled documents' requests, scored by the stand-in model (tfm
mode), truth from the request persona's class rule. Labels are joined before
anything is segmented, and only held-out clauses are scored. The confusion
matrix is indexed like the reference's: class index = argmax of the one-hot
pair, so index 0 is worth_reading (label 1) and index 1 standard_trivial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.aggregates import confusion_matrix, holdout_metrics, sensitivity_specificity
from clausewise.operators.labels import argmax, encode_fixed, one_hot
from clausewise.operators.sampling import train_test_split
from clausewise.operators.segment import segment_clauses
from clausewise.plans import analyse
from clausewise.sources import tables
from clausewise.sources.corpus import PERSONAS, WORTH, class_rules

# Fixed value: beyond this logit gap exp() overflows; the probability is 0.
EXP_LIMIT = 700.0


def worth_probability(score: F.Column) -> F.Column:
    """Softmax over two logits: P(worth) = 1 / (1 + exp(s0 - s1))."""
    x = F.element_at(score, 1) - F.element_at(score, 2)
    return F.when(x > F.lit(EXP_LIMIT), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(x)))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    labelled = analyse.valid_requests(spark, sf_dir).join(lab, "doc_id")
    clauses = segment_clauses(labelled, keep=(*analyse.REQUEST_KEYS, "quality", "toxic"))
    held = train_test_split(clauses, ["alertness"], ["doc_id", "clause_no"]).where(F.col("split") == "test")
    c = analyse.classify_with_rule(held).where(F.col("decode_error").isNull())
    rules = class_rules(F.col("quality"), F.col("toxic"))
    # truth: the request persona's own class rule
    worth = None
    for p in PERSONAS:
        cond = (F.col("alertness") == p) & (rules[p] == F.lit(WORTH))
        worth = cond if worth is None else (worth | cond)
    return (c
             .select(F.col("alertness").alias("persona"), "doc_id", "clause_no",
                     worth.cast("int").alias("label"), encode_fixed(F.col("class")).alias("prediction"),
                     worth_probability(F.col("score")).alias("p1")))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation_rows(spark, sf_dir)
    idx = r.select("persona", argmax(one_hot(F.col("label"))).alias("y"),
                   argmax(one_hot(F.col("prediction"))).alias("p"))
    return confusion_matrix(idx, ["persona"], "y", "p")


def sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity_specificity(confusion(spark, sf_dir))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_metrics(evaluation_rows(spark, sf_dir), ["persona"])
