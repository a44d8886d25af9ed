"""A deterministic stand-in model: two logits from token counts.

The reference scores clauses with trained networks whose weights are not in
its checkout. For checkable end-to-end runs we use a fixed function of the
clause's tokens (our choice, stated here):

    logit_standard = 0.5 * n_tokens + 0.25
    logit_worth    = number of tokens of 7 or more characters

The +0.25 keeps the two from ever tying. It exists in two forms that must agree:
a built-in expression (stays in codegen) and a NumPy batch function for the
``predict_batch_udf`` path (O-33c), which is how a caller plugs in a real model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stand-in model.
LONG_WORD = 7
STANDARD_SLOPE = 0.5
STANDARD_BIAS = 0.25


def count_features(tokens: Column) -> tuple[Column, Column]:
    n_tokens = F.size(tokens).cast("long")
    n_long = F.size(F.filter(tokens, lambda w: F.length(w) >= F.lit(LONG_WORD))).cast("long")
    return n_tokens, n_long


def rule_logits(tokens: Column) -> Column:
    n_tokens, n_long = count_features(tokens)
    return F.array((n_tokens.cast("double") * F.lit(STANDARD_SLOPE) + F.lit(STANDARD_BIAS)),
                   n_long.cast("double"))


def rule_logits_numpy(n_tokens: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """Batch form for predict_batch_udf: (batch,) x 2 -> (batch, 2)."""
    s0 = n_tokens.astype(np.float64) * STANDARD_SLOPE + STANDARD_BIAS
    s1 = n_long.astype(np.float64)
    return np.stack([s0, s1], axis=1)
