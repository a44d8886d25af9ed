"""Sampling queries: exact split of the labelled corpus, SMOTE on embeddings.

SMOTE enlarges every label of ``embeddings`` that has fewer rows than the
largest one; neighbours are searched within the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.approx_knn import approximate_knn
from clausewise.operators.sampling import exact_knn, smote, train_test_split
from clausewise.session import stage
from clausewise.sources import corpus, tables


def split_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = corpus.labelled_clauses(spark, sf_dir).select("persona", "doc_id", "clause_no")
    return train_test_split(lab, ["persona"], ["doc_id", "clause_no"])


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return e.select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("id"),
                    F.col("embedding").alias("vec"))


def _minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = labelled_points(spark, sf_dir)
    counts = pts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    below = counts.where(F.col("n") < counts.select(F.max("n")).scalar()).select("label")
    return pts.join(below, "label")


def smote_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_knn(_minority(spark, sf_dir), scope_col="label").select("label", "id", "nb_id", "dist", "nb_rank")


def smote_neighbours_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From random-projection buckets (rows only; recall is measured in the tests)."""
    return approximate_knn(_minority(spark, sf_dir), stage, scope_col="label").select("label", "id", "nb_id", "dist", "nb_rank")


def smote_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smote(labelled_points(spark, sf_dir))
