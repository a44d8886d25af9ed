"""O-06 as queries: a base and two deltas of the labelled clauses, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.increments import Book
from clausewise.plans import bow
from clausewise.plans.bow import KEYS, LABEL_COLS
from clausewise.plans.training import run_folder

# doc_id modulo 4: 0 and 1 are the base, 2 and 3 a delta each.
PARTS = ((0, 1), (2,), (3,))


def corpus_book(spark: SparkSession, sf_dir: str) -> Book:
    units = bow.staged_units(spark, sf_dir)
    book = Book(spark, run_folder(spark), KEYS, LABEL_COLS)
    for rest in PARTS:
        book.add(units.where(F.pmod("doc_id", F.lit(4)).isin(*rest)))
    return book


def incremental_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary and statistics of the whole corpus, merged from the versions' parts."""
    book = corpus_book(spark, sf_dir)
    n = book.sizes().select("n_units").scalar()
    joined = book.vocabulary().join(book.sums(), "term").withColumn("n_units", n)
    return joined.select("term", "multiplicity", "first_doc_id", "first_clause_no", "first_pos", "last_doc_id", "last_clause_no",
                         "last_pos", "total", F.col("q").alias("total_sq"), "n_units", *[f"s1_{x}" for x in LABEL_COLS])


def incremental_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all words: those of the base first, then each delta's new words."""
    return corpus_book(spark, sf_dir).dictionary()
