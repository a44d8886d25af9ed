"""O-34..O-36: scores -> classes, per mode.

The reference aborts the whole run on a tie or NaN. A corpus job should not,
so by default such a clause gets class NULL and a ``decode_error``; with
``strict=True`` the query fails through ``raise_error`` instead. NaN is tested
first: Spark orders NaN above every number, so ``NaN > 0.5`` would otherwise
decode as worth_reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.sources.corpus import STANDARD, WORTH

MODES = ("bow", "bert", "tfm")


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def decode_columns(score: Column, mode: str) -> tuple[Column, Column]:
    """(class, decode_error) for an ARRAY<DOUBLE> score column."""
    if mode not in MODES:
        raise ValueError(f"unknown decoding mode {mode!r}; one of {MODES}")
    # get() is NULL out of range; try_element_at inside a filtered CASE hit a
    # whole-stage codegen compile error in Spark 4.1 (interpreted fallback)
    s0 = F.get(score, F.lit(0)).cast("double")
    if mode == "bert":
        lo, hi, bad = s0 < F.lit(0.5), s0 > F.lit(0.5), _bad(s0)
    else:
        s1 = F.get(score, F.lit(1)).cast("double")
        if mode == "tfm":
            s0, s1 = F.abs(s0), F.abs(s1)
        lo, hi, bad = s0 > s1, s0 < s1, _bad(s0) | _bad(s1)
    cls = F.when(bad, F.lit(None).cast("string")).when(lo, F.lit(STANDARD)).when(hi, F.lit(WORTH))
    err = F.when(bad, F.lit("nan_score")).when(~lo & ~hi, F.lit("tie"))
    return cls, err


def decode(scores: DataFrame, mode: str, score_col: str = "score", strict: bool = False) -> DataFrame:
    cls, err = decode_columns(F.col(score_col), mode)
    out = scores.withColumn("class", cls).withColumn("decode_error", err)
    if strict:
        out = out.withColumn("class", F.when(F.col("decode_error").isNull(), F.col("class"))
                             .otherwise(F.raise_error(F.concat(F.lit("clause cannot be decoded: "),
                                                               F.col("decode_error")))))
    return out
