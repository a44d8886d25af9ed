"""Corpus-level reports over the labelled tables (build-plan step 1)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.aggregates import class_counts, with_ratios
from clausewise.operators.segment import segment_clauses
from clausewise.session import checkpoint_dir
from clausewise.sources import tables
from clausewise.sources.corpus import PERSONAS, class_rules, labelled_clauses
from clausewise.sources.files import file_lines, good_rows, read_labelled_csv, write_labelled_csv


def persona_source_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of standard and worth-reading clauses per persona and source.

    documents JOIN labels -> segment (narrow) -> one row per persona (narrow)
    -> partial count per (persona, source) -> one shuffle of partial counts.
    """
    docs = tables.documents(spark, sf_dir).select("doc_id", "source", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    seg = segment_clauses(docs.join(lab, "doc_id"), keep=("source", "quality", "toxic"))
    rules = class_rules(F.col("quality"), F.col("toxic"))
    per_persona = F.array(*[F.struct(F.lit(p).alias("persona"), rules[p].alias("class"))
                            for p in PERSONAS])
    classified = seg.select("source", F.inline(per_persona))
    return with_ratios(class_counts(classified, ["persona", "source"]))


def doc_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-03 over the shared tables: ``doc_id, clause_no, clause`` where a clause
    keeps its line end, as a text file iterated line by line gives it (the file
    of a document is its text and a newline). The expression is the one the
    text-file source applies to whole files; nothing is written."""
    docs = tables.documents(spark, sf_dir)
    lines = file_lines(F.concat(F.col("text"), F.lit("\n")))
    return docs.select("doc_id", F.posexplode(lines).alias("clause_no", "clause")) \
        .withColumn("clause_no", F.col("clause_no").cast("long"))


def labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01/O-05: the labelled clauses written as CSV files per persona (in the
    shared folder) and read back with validation: ``persona, clause, class``."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/labelled-{uuid.uuid4().hex[:12]}"
    write_labelled_csv(labelled_clauses(spark, sf_dir), root)
    return good_rows(read_labelled_csv(spark, root)).select("persona", "clause", "class")
