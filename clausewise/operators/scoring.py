"""O-33: features of the sequence model, and external batch scorers.

Models of our own are weight tables (``operators.descent`` fits, ``operators.linear``
applies them): bag-of-words on standardised containment counts (O-41), sequences
on the presence of id n-grams (O-42, the CNN's "window of 2/3/4 anywhere in the
clause" signal). A caller's model is a batch function through
``predict_batch_udf`` (O-33c).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The window widths of the sequence model.
WINDOWS = (2, 3, 4)


def gram_cells(ids: DataFrame, keys: Sequence[str], ids_col: str = "input_ids", windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``keys..., feature, n = 1``: each id n-gram that stands anywhere in the sequence,
    written as its ids with spaces."""
    # a generator keeps the strings from being made again for every n-gram
    rows = ids.select(*keys, F.explode(F.array(F.transform(ids_col, lambda x: x.cast("string")))).alias("_s"))
    size = F.size("_s")

    def grams(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - (width - 1), F.lit(1)))
        return F.when(size >= width, F.transform(starts, lambda i: F.array_join(F.slice("_s", i, F.lit(width)), " "))) \
            .otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*[grams(w) for w in windows]))
    return rows.select(*keys, F.explode(every).alias("feature")).withColumn("n", F.lit(1).cast("long"))


def batch_scorer(fn: Callable[..., np.ndarray], n_inputs: int, batch_size: int = 4096) -> Callable[..., Column]:
    """O-33c: wrap a caller's NumPy batch function ``fn(col_1, ..., col_n) ->
    (batch, 2)`` as a vectorised UDF. The inputs travel as one (batch, n)
    tensor in Arrow batches; the function sees one array per input column."""
    def make_predict_fn():
        def predict(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64).reshape(-1, n_inputs)
            return fn(*[x[:, i] for i in range(n_inputs)])
        return predict
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[n_inputs]])

    def apply(*cols: Column) -> Column:
        return udf(F.array(*[c.cast("double") for c in cols]))
    return apply
