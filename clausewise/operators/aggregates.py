"""O-15..O-19 and O-22..O-24: the reference's aggregates as grouped Spark jobs.

Every aggregate here is algebraic (count/sum/min/max), so Spark combines it
map-side before the shuffle: a hot group (one source holding a third of all
rows) costs one partial row per map task, not one row per clause.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions.ratio import percent
from clausewise.sources.corpus import STANDARD, WORTH


def class_counts(classified: DataFrame, keys: Sequence[str], class_col: str = "class") -> DataFrame:
    """O-17: ``keys..., standard_n, worth_n`` (decode errors are in neither)."""
    c = F.col(class_col)
    return classified.groupBy(*keys).agg(
        F.count_if(c == F.lit(STANDARD)).cast("long").alias("standard_n"),
        F.count_if(c == F.lit(WORTH)).cast("long").alias("worth_n"))


def with_ratios(counts: DataFrame) -> DataFrame:
    """O-18/O-19: percent of standard and of worth-reading clauses."""
    n = F.col("standard_n") + F.col("worth_n")
    return (counts
            .withColumn("standard_ratio", percent(F.col("standard_n"), n))
            .withColumn("worth_ratio", percent(F.col("worth_n"), n)))


def max_length(df: DataFrame, keys: Sequence[str], array_col: str) -> DataFrame:
    """O-15: longest sequence per key."""
    return df.groupBy(*keys).agg(F.max(F.size(array_col)).cast("long").alias("max_length"))


def shape_check(df: DataFrame, keys: Sequence[str], array_col: str) -> DataFrame:
    """O-16: all arrays of one length (true for an empty group by definition)."""
    return df.groupBy(*keys).agg(
        (F.count_distinct(F.size(array_col)) <= 1).alias("equal_length"),
        F.count(F.lit(1)).cast("long").alias("n_rows"))


def confusion_matrix(df: DataFrame, keys: Sequence[str], label_col: str = "label",
                     pred_col: str = "prediction") -> DataFrame:
    """O-22: 2x2 counts c00, c01, c10, c11 (row = true label, column = prediction)."""
    y = F.col(label_col).cast("int")
    p = F.col(pred_col).cast("int")
    cells = {f"c{i}{j}": F.count_if((y == i) & (p == j)).cast("long") for i in (0, 1) for j in (0, 1)}
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in cells.items()])


def sensitivity_specificity(cm: DataFrame) -> DataFrame:
    """O-23: c00/(c00+c01) and c11/(c11+c10); NULL on an empty row."""
    return (cm
            .withColumn("sensitivity", F.try_divide(F.col("c00").cast("double"),
                                                    (F.col("c00") + F.col("c01")).cast("double")))
            .withColumn("specificity", F.try_divide(F.col("c11").cast("double"),
                                                    (F.col("c11") + F.col("c10")).cast("double"))))


# Fixed value (our convention): probabilities are clipped to [EPS, 1 - EPS]
# before the logarithm of the cross-entropy loss.
EPS = 1e-7


def holdout_metrics(df: DataFrame, keys: Sequence[str], label_col: str = "label",
                    pred_col: str = "prediction", p1_col: str = "p1") -> DataFrame:
    """O-24: accuracy and mean binary cross-entropy per key."""
    y = F.col(label_col).cast("int")
    p1 = F.least(F.greatest(F.col(p1_col).cast("double"), F.lit(EPS)), F.lit(1.0 - EPS))
    p_true = F.when(y == 1, p1).otherwise(F.lit(1.0) - p1)
    return df.groupBy(*keys).agg(
        F.avg((y == F.col(pred_col).cast("int")).cast("double")).alias("accuracy"),
        F.avg(-F.ln(p_true)).alias("loss"),
        F.count(F.lit(1)).cast("long").alias("n_rows"))
