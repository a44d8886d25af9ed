"""O-04, O-08, O-09: parse JSON analysis requests and validate them.

One ``from_json`` pass. The body is parsed as the only element of an array:
that way text after the object makes it malformed (or a second element), where
parsing the object alone would ignore the rest. Every request gets either a
NULL ``reason`` (valid) or the first check it fails: JSON, persona, text, title.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.sources.corpus import PERSONAS

REQUEST_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("alertness", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
]))


def parse(raw: DataFrame, body_col: str = "body", id_col: str = "request_id", keep: Sequence[str] = ()) -> DataFrame:
    """``request_id, keep.., alertness, title, text, reason``."""
    body = F.concat(F.lit("["), F.col(body_col), F.lit("]"))
    # The parsed array is the single input row of an inline(): the optimizer
    # would otherwise inline from_json into every later reference (each check
    # of the reason, each field, and the pushed-down validity filter), i.e.
    # parse every document several times. A generator is not collapsed into
    # its consumers, so each body is parsed exactly once.
    parsed = F.inline(F.array(F.struct(F.from_json(body, REQUEST_SCHEMA, {"mode": "PERMISSIVE"}).alias("a"))))
    p = raw.select(F.col(id_col).alias("request_id"), *keep, parsed)
    r = F.get("a", F.lit(0))
    alert, text = r["alertness"], r["text"]
    reason = (F.when(F.col("a").isNull() | (F.size("a") != 1) | r.isNull(), F.lit("invalid_json"))
              .when(alert.isNull(), F.lit("missing_alertness"))
              .when(~alert.isin(*PERSONAS), F.lit("invalid_alertness"))
              .when(text.isNull(), F.lit("missing_text"))
              .when(text == F.lit(""), F.lit("empty_text"))
              .when(r["title"].isNull(), F.lit("missing_title")))
    return p.select("request_id", *keep, alert.alias("alertness"), r["title"].alias("title"),
                    text.alias("text"), reason.alias("reason"))


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    """Quarantine output: ``request_id, reason``."""
    return parsed.where(F.col("reason").isNotNull()).select("request_id", "reason")
