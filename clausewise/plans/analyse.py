"""O-40: whole-request analysis over many requests at once.

requests (JSON) -> parse/validate -> segment -> tokens and scores -> decode ->
counts, ratio, worth positions and the annotated map. Everything is narrow: a
request is one row and the reports are built from arrays in that row. Rejected
requests go to a separate output instead of aborting the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.scorer import rule_logits
from clausewise.functions.text import token_array
from clausewise.operators.decode import decode
from clausewise.operators.report import classified_array, document_report, marked
from clausewise.operators.segment import segment_clauses
from clausewise.session import stage
from clausewise.sources import corpus, requests

REQUEST_KEYS = ("doc_id", "alertness", "title")


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, alertness, title, text``."""
    parsed = requests.parse(corpus.raw_requests(spark, sf_dir))
    return requests.valid(parsed).withColumnRenamed("request_id", "doc_id")


def request_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid requests split into clauses: ``doc_id, alertness, title, clause_no, clause``."""
    return segment_clauses(valid_requests(spark, sf_dir), keep=REQUEST_KEYS)


def request_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persona, doc_id, clause_no, tokens`` of the valid requests as a stage: parsed and
    tokenised once for the words, the chunks and the sizes."""
    rows = request_clauses(spark, sf_dir).select(F.col("alertness").alias("persona"), "doc_id", "clause_no",
                                                 token_array(F.col("clause")).alias("tokens"))
    return stage(rows, "request-tokens")


def classify_with_rule(clauses: DataFrame, mode: str = "tfm") -> DataFrame:
    """Score with the stand-in model and decode in the given mode."""
    scored = clauses.withColumn("score", rule_logits(token_array(F.col("clause"))))
    return decode(scored, mode).withColumn("mode", F.lit(mode))


def classified_requests(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    return classify_with_rule(request_clauses(spark, sf_dir), mode)


def classified_sink_rows(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    """O-05 rows as written: title without spaces (the file name part), unmarked clause."""
    c = classified_requests(spark, sf_dir, mode)
    return c.select("doc_id", "clause_no", "clause", "class", "decode_error", "mode",
                    F.replace(F.col("title"), F.lit(" "), F.lit("")).alias("title"))


def marked_clauses(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    c = classified_requests(spark, sf_dir, mode)
    return c.select("doc_id", "clause_no", "class", marked(F.col("clause"), F.col("class")).alias("marked_clause"))


def rule_report(valid: DataFrame, mode: str = "tfm") -> DataFrame:
    """Reports of valid requests under the stand-in model, one row each."""
    return document_report(valid, REQUEST_KEYS, classified_array(F.col("text"), rule_logits, mode))


def request_reports(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    return rule_report(valid_requests(spark, sf_dir), mode)


def analyse_requests(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    """Per request: persona, title, counts, standard ratio, worth positions."""
    r = request_reports(spark, sf_dir, mode)
    return r.select("doc_id", "alertness", "title", "standard_n", "worth_n", "error_n",
                    "standard_ratio", "worth_indices")


def annotated_documents(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    """The annotated map, one row per entry (the JSON text is never compared)."""
    r = request_reports(spark, sf_dir, mode)
    return r.select("doc_id", "standard_ratio", F.explode("clause_map").alias("clause_key", "clause"))


def worth_indices(spark: SparkSession, sf_dir: str, mode: str = "tfm") -> DataFrame:
    r = request_reports(spark, sf_dir, mode)
    return r.select("doc_id", "worth_indices")
