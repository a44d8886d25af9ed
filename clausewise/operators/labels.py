"""O-25..O-27: label encodings.

First-seen encoding needs, per scope, only the first position of each class:
a partial ``min`` per (scope, class) that shuffles one row per class per map
task, then a join back on (scope, class). The class table is tiny by
construction (two valid labels per scope; a third is an error); AQE sees its
measured size after the aggregate and broadcasts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.sources.corpus import WORTH


def encode_first_seen(df: DataFrame, scope: Sequence[str], order: Sequence[str],
                      class_col: str = "class") -> DataFrame:
    """Adds ``label`` (0 for the first class seen in ``order``, 1 for the
    second) and ``encode_error`` ('third_label' for any later class)."""
    firsts = (df.groupBy(*scope, class_col)
              .agg(F.min(F.struct(*order)).alias("_first")))
    w = Window.partitionBy(*scope).orderBy("_first")
    ranked = (firsts
              .withColumn("_rank", F.row_number().over(w) - 1)
              .select(*scope, class_col, "_rank"))
    out = df.join(ranked, [*scope, class_col], "left")
    return (out
            .withColumn("label", F.when(F.col("_rank") <= 1, F.col("_rank").cast("int")))
            .withColumn("encode_error", F.when(F.col("_rank") > 1, F.lit("third_label")))
            .drop("_rank"))


def encode_fixed(class_col: Column) -> Column:
    """O-26: worth_reading -> 1, anything else -> 0."""
    return F.when(class_col == F.lit(WORTH), F.lit(1)).otherwise(F.lit(0))


def one_hot(label: Column) -> Column:
    """O-27: 0 -> [0, 1], 1 -> [1, 0], anything else -> NULL."""
    return (F.when(label == 0, F.array(F.lit(0), F.lit(1)))
            .when(label == 1, F.array(F.lit(1), F.lit(0))))


def argmax(arr: Column) -> Column:
    """Inverse of one_hot: 0-based position of the maximum, first on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
