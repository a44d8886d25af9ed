"""E3 as Spark jobs: labelled clauses -> vocabulary -> vectors -> statistics.

The labelled corpus is tokenised once per clause and only then fanned out to
the personas (narrow ``inline``), so the regex work is not repeated per
persona. Scope of every statistic is the persona.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.text import token_array
from clausewise.operators.labels import encode_fixed
from clausewise.operators.segment import segment_clauses
from clausewise.operators.stats import (TOP_K, anova_from_sums, scope_sizes, select_top_k, standardise, stats_from_sums,
                                        term_stats, with_z)
from clausewise.operators.vocab import containment_sums, containment_vectors, existence_vectors, vocabulary
from clausewise.session import stage
from clausewise.sources import tables
from clausewise.sources.corpus import PERSONAS, class_rules, persona_of

SCOPE = ["persona"]
KEYS = ["doc_id", "clause_no"]


def labelled_token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persona, doc_id, clause_no, class, label, tokens``."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    seg = segment_clauses(docs.join(lab, "doc_id"), keep=("doc_id", "quality", "toxic"))
    tok = seg.withColumn("tokens", token_array(F.col("clause")))
    rules = class_rules(F.col("quality"), F.col("toxic"))
    per_persona = F.array(*[F.struct(F.lit(p).alias("persona"), rules[p].alias("class"))
                            for p in PERSONAS])
    return (tok.select(F.inline(per_persona), "doc_id", "clause_no", "tokens")
               .withColumn("label", encode_fixed(F.col("class"))))


def labelled_token_rows(lta: DataFrame) -> DataFrame:
    return lta.select(*SCOPE, *KEYS, "label", F.explode("tokens").alias("word"))


# --- shared-corpus plan -----------------------------------------------------
# In the labelled corpus the three personas read the SAME clauses and differ
# only in their labels. Tokens, vocabulary and containment cells are
# therefore computed once per clause, with the three labels carried as
# columns, and fanned out to the personas only where an output needs the
# persona (a narrow inline). This is exact: each persona's vocabulary is the
# corpus vocabulary. The per-scope operators stay generic for corpora whose
# personas hold different clauses.

LABEL_COLS = [f"label_{p}" for p in PERSONAS]


def corpus_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, clause_no, tokens, label_alice, label_bob, label_charlie``."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    seg = segment_clauses(docs.join(lab, "doc_id"), keep=("doc_id", "quality", "toxic"))
    rules = class_rules(F.col("quality"), F.col("toxic"))
    return seg.select(*KEYS, token_array(F.col("clause")).alias("tokens"),
                      *[encode_fixed(rules[p]).alias(f"label_{p}") for p in PERSONAS])


def staged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_units`` as a Parquet stage, for queries that read it several times."""
    return stage(corpus_units(spark, sf_dir), "units")


def _fan_out() -> F.Column:
    return F.inline(F.array(*[F.struct(F.lit(p).alias("persona"), F.col(f"label_{p}").alias("label"))
                              for p in PERSONAS]))


def _personas() -> F.Column:
    return F.explode(F.array(*[F.lit(p) for p in PERSONAS])).alias("persona")


def corpus_vocabulary(units: DataFrame) -> DataFrame:
    return stage(vocabulary(units, [], KEYS), "vocabulary")


def corpus_cells(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    vocab = corpus_vocabulary(units)
    return containment_vectors(units, vocab, [], KEYS, carry=LABEL_COLS, vocab_from_same_tokens=True), vocab


def corpus_sums(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, total, q, s1_label_..`` and the vocabulary: for queries that need no cell."""
    vocab = corpus_vocabulary(units)
    return containment_sums(units, vocab, [], KEYS, LABEL_COLS, vocab_from_same_tokens=True), vocab


def corpus_sizes(units: DataFrame) -> DataFrame:
    return scope_sizes(units.select(_fan_out()), SCOPE, "label")


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(corpus_units(spark, sf_dir), [], KEYS)
    return vocab.select(_personas(), *vocab.columns)


def bow_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training every token is a vocabulary term, so no join is needed."""
    ex = existence_vectors(corpus_units(spark, sf_dir), None, [], KEYS)
    return ex.select(_personas(), *KEYS, "term", "n")


def bow_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = corpus_cells(staged_units(spark, sf_dir))
    return cells.select(_personas(), *KEYS, "term", "n")


def _corpus_stats(units: DataFrame, sums: DataFrame) -> DataFrame:
    n_units = units.select(F.count(F.lit(1)).cast("long")).scalar()
    return stats_from_sums(sums.select("term", "total", F.col("q").alias("total_sq")), n_units, [])


def term_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = staged_units(spark, sf_dir)
    sums, _ = corpus_sums(units)
    st = _corpus_stats(units, sums)
    return st.select(_personas(), *st.columns)


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = staged_units(spark, sf_dir)
    sums, vocab = corpus_sums(units)
    st = stage(_corpus_stats(units, sums).select("term", "mean", "std"), "term-stats")
    z = with_z(containment_vectors(units, vocab, [], KEYS, carry=LABEL_COLS, vocab_from_same_tokens=True, values=st))
    return z.select(_personas(), *KEYS, "term", "n", "z")


def _anova(units: DataFrame, sums: DataFrame) -> DataFrame:
    """One row per term with a conditional sum per persona's label; only these
    rows are fanned out to the personas."""
    per_persona = F.inline(F.array(*[
        F.struct(F.lit(p).alias("persona"), (F.col("total") - F.col(f"s1_label_{p}")).alias("s0"),
                 F.col(f"s1_label_{p}").alias("s1")) for p in PERSONAS]))
    return anova_from_sums(sums.select("term", "q", per_persona), corpus_sizes(units), SCOPE)


def anova_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = staged_units(spark, sf_dir)
    return _anova(units, corpus_sums(units)[0])


def selection(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    units = staged_units(spark, sf_dir)
    top = _selected_terms(units, *corpus_sums(units), k)
    return top.select(*SCOPE, "term", "f", "multiplicity", "selected_multiplicity", "rank")


def _selected_terms(units: DataFrame, sums: DataFrame, vocab: DataFrame, k: int = TOP_K) -> DataFrame:
    f = _anova(units, sums)
    per_persona_vocab = vocab.select(_personas(), *vocab.columns)
    scored = f.join(per_persona_vocab, [*SCOPE, "term"], "right").select(
        *SCOPE, "term", "f", "multiplicity", "last_doc_id", "last_clause_no", "last_pos")
    return select_top_k(scored, SCOPE, k, tie_cols=["last_doc_id", "last_clause_no", "last_pos"])


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 feature step for new documents (requests): containment counts
    against the request persona's selected terms (O-12 + the O-29 mask), and
    the scaler re-fitted on each document as the reference does (O-28,
    scope = document; N = the document's clauses)."""
    from clausewise.plans import analyse

    units = staged_units(spark, sf_dir)
    # stored tables: each of them is read several times, and its plan would stand in this one as often
    selected = stage(_selected_terms(units, *corpus_sums(units)).select(*SCOPE, "term"), "selected")
    rc = analyse.request_tokens(spark, sf_dir)
    dcells = stage(containment_vectors(rc, selected, SCOPE, KEYS), "document-cells")
    sizes = rc.groupBy("persona", "doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_units"))
    stats = term_stats(dcells, sizes, ["persona", "doc_id"])
    z = standardise(dcells, stats, ["persona", "doc_id"])
    return z.select("persona", *KEYS, "term", "n", "z")


def bow_by_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11/O-12 with a corpus of its own per persona, as the reference has them:
    a persona holds the clauses of its own documents (``doc_id`` modulo three),
    so vocabulary and containment run per scope."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id")
    seg = segment_clauses(docs.join(lab, "doc_id"))
    units = stage(seg.select(persona_of(F.col("doc_id")).alias("persona"), *KEYS,
                             token_array(F.col("clause")).alias("tokens")), "persona-units")
    vocab = stage(vocabulary(units, SCOPE, KEYS), "persona-vocabulary")
    return containment_vectors(units, vocab, SCOPE, KEYS)
