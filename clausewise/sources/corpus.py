"""Stand-ins for the reference's inputs, derived from the shared tables.

* requests: one JSON request per document; persona by ``doc_id % 3``,
  title = ``source``.
* labelled clauses: clauses of labelled documents, one copy per persona, with
  the persona's class rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.segment import segment_clauses
from clausewise.sources import tables

# The three reader personas, in the order used by doc_id % 3, and
# the two classes.
PERSONAS = ("alice", "bob", "charlie")
WORTH = "worth_reading"
STANDARD = "standard_trivial"


def persona_of(doc_id: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(p) for p in PERSONAS]),
                        (F.pmod(doc_id, F.lit(3)) + 1).cast("int"))


def class_rules(quality: F.Column, toxic: F.Column) -> dict[str, F.Column]:
    """Our persona labelling rule over ``labels`` (the reference does not say)."""
    def cls(cond: F.Column) -> F.Column:
        return F.when(cond, F.lit(WORTH)).otherwise(F.lit(STANDARD))
    return {
        "alice": cls(quality == 1),
        "bob": cls(toxic == 1),
        "charlie": cls((quality == 1) & (toxic == 0)),
    }


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    return segment_clauses(docs)


def labelled_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persona, doc_id, clause_no, clause, class``.

    The label join happens before segmentation so only labelled documents are
    split; AQE turns it into a broadcast when the labels turn out small at run
    time, otherwise it stays a shuffle join on doc_id.
    """
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    joined = docs.join(lab, "doc_id")
    rules = class_rules(F.col("quality"), F.col("toxic"))
    per_persona = F.array(*[F.struct(F.lit(p).alias("persona"), rules[p].alias("class"))
                            for p in PERSONAS])
    seg = segment_clauses(joined, keep=("doc_id", "quality", "toxic"))
    return (seg
            .select(F.inline(per_persona), "doc_id", "clause_no", "clause")
            .select("persona", "doc_id", "clause_no", "clause", "class"))


# doc_id % DEFECT_CYCLE -> the defect of that document's request.
DEFECT_CYCLE = 50
DEFECTS = {7: "truncated", 12: "trailing_text", 17: "unknown_persona", 22: "no_persona", 27: "empty_text",
           32: "no_text", 37: "no_title", 42: "blank_text"}


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, body``: the JSON request each document stands for. One in
    ``DEFECT_CYCLE`` documents each stands for a defective body, and one for a
    valid request without any clause (``blank_text``)."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "source", "text")
    slot = {v: F.col("doc_id") % DEFECT_CYCLE == k for k, v in DEFECTS.items()}
    persona = F.when(slot["unknown_persona"], F.lit("dave")).when(~slot["no_persona"], persona_of(F.col("doc_id")))
    text = (F.when(slot["empty_text"], F.lit("")).when(slot["blank_text"], F.lit(" \n\t"))
            .when(~slot["no_text"], F.col("text")))
    # to_json leaves null fields out
    body = F.to_json(F.struct(persona.alias("alertness"), F.when(~slot["no_title"], F.col("source")).alias("title"),
                              text.alias("text")))
    body = (F.when(slot["truncated"], F.substring(body, F.lit(1), F.length(body) - 1))
            .when(slot["trailing_text"], F.concat(body, F.lit(" and more"))).otherwise(body))
    return docs.select(F.col("doc_id").alias("request_id"), body.alias("body"))
