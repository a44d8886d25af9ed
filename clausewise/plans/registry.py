"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from clausewise.plans import (analyse, bow, corpus_reports, evaluate, features, incremental, models, rebalance, resample, scores,
                              sequence, training)
from clausewise.sources import corpus, requests

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.analyse_requests(spark, sf_dir)


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.valid(requests.parse(corpus.raw_requests(spark, sf_dir)))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rejected(requests.parse(corpus.raw_requests(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {
        "persona_source_ratios": corpus_reports.persona_source_ratios,
        "segment_clauses": corpus.clauses,
        "doc_clauses": corpus_reports.doc_clauses,
        "tokenise_clauses": features.all_tokens,
        "labelled_clauses": corpus.labelled_clauses,
        "parse_requests": _parse,
        "rejected_requests": _rejected,
        "decode_bow": partial(scores.decoded, mode="bow"),
        "decode_bert": partial(scores.decoded, mode="bert"),
        "decode_tfm": partial(scores.decoded, mode="tfm"),
        "doc_class_counts": scores.doc_class_counts,
        "doc_ratios": scores.doc_ratios,
        "encode_first_seen": features.first_seen_labels,
        "encode_fixed": features.fixed_labels,
        "one_hot": features.one_hot_labels,
        "classified_clauses": analyse.classified_sink_rows,
        "marked_clauses": analyse.marked_clauses,
        "worth_indices": analyse.worth_indices,
        "annotated_documents": analyse.annotated_documents,
        "analyse_requests": analyse.analyse_requests,
        "vocabulary": bow.vocabulary_table,
        "bow_exists": bow.bow_exists,
        "bow_contains": bow.bow_contains,
        "term_stats": bow.term_stats_table,
        "standardise": bow.standardised,
        "anova_f": bow.anova_table,
        "select_top_k": bow.selection,
        "document_features": bow.document_features,
        "special_tokens": sequence.special_token_clauses,
        "encode_ids": sequence.clause_ids,
        "max_length_by_persona": sequence.max_length_by_persona,
        "pad_ids": sequence.padded_ids,
        "shape_check": sequence.shape_report,
        "model_input": sequence.transformer_inputs,
        "train_test_split": resample.split_labelled,
        "smote_neighbours": resample.smote_neighbours,
        "smote_samples": resample.smote_samples,
        "smote_neighbours_approximate": resample.smote_neighbours_approximate,
        "smote_bow_neighbours": rebalance.smote_bow_neighbours,
        "smote_bow_samples": rebalance.smote_bow_samples,
        "anova_after_smote": rebalance.anova_after_smote,
        "select_after_smote": rebalance.select_after_smote,
        "select_columns": rebalance.selected_columns,
        "smote_sequences": rebalance.smote_sequences,
        "confusion_matrix": evaluate.confusion,
        "sens_spec": evaluate.sens_spec,
        "holdout_metrics": evaluate.holdout,
        "score_bow": training.score_bow,
        "score_sequence": training.score_sequence,
        "training_metrics": training.training_metrics,
        "best_run": training.best_run,
        "analyse_requests_fitted": training.analyse_requests_fitted,
        "analyse_requests_refit": training.analyse_requests_refit,
        "score_external": models.score_external,
        "analyse_requests_bow": models.analyse_requests_bow,
        "analyse_requests_sequence": models.analyse_requests_sequence,
        "best_run_table": models.best_run_table,
        "incremental_terms": incremental.incremental_terms,
        "incremental_dictionary": incremental.incremental_dictionary,
        "labelled_csv": corpus_reports.labelled_csv,
        "bow_by_persona": bow.bow_by_persona,
    }
