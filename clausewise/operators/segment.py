"""O-07: documents -> ordered clauses; O-10: clauses -> tokens.

Both are narrow: the array of clauses (or tokens) is built inside the row and
``posexplode`` numbers it, so consecutive positions come without a window or a
shuffle, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import clause_array, lower_token_array, token_array


def segment_clauses(docs: DataFrame, text_col: str = "text",
                    keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per non-blank line: ``keep..., clause_no BIGINT (0-based), clause``."""
    return (docs
            .select(*keep, F.posexplode(clause_array(F.col(text_col))).alias("clause_no", "clause"))
            .withColumn("clause_no", F.col("clause_no").cast("long")))


def tokenise(clauses: DataFrame, keep: Sequence[str], clause_col: str = "clause",
             lower: bool = False, outer: bool = False) -> DataFrame:
    """One row per token: ``keep..., pos BIGINT (0-based), word``.

    ``outer=True`` keeps clauses without tokens as one row with NULL pos/word.
    """
    arr = lower_token_array(F.col(clause_col)) if lower else token_array(F.col(clause_col))
    gen = F.posexplode_outer(arr) if outer else F.posexplode(arr)
    return (clauses
            .select(*keep, gen.alias("pos", "word"))
            .withColumn("pos", F.col("pos").cast("long")))


def with_token_array(clauses: DataFrame, clause_col: str = "clause", out: str = "tokens",
                     lower: bool = False) -> DataFrame:
    arr = lower_token_array(F.col(clause_col)) if lower else token_array(F.col(clause_col))
    return clauses.withColumn(out, arr)
