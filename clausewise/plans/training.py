"""O-33a/b, O-41..O-43: models fitted as weight tables, and what they score.

The personas read the same clauses and differ in their labels, so one run
(``operators.descent.Training``) fits the models of all personas, for every penalty,
in the same passes. Split first: vocabulary, dictionary of n-grams, statistics and
selection see the training clauses only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import linear
from clausewise.operators.decode import decode
from clausewise.operators.descent import (STEPS, Model, Training, best_epochs, linear_weights, merged_columns, plain_features,
                                          sigmoid, standardised_weights)
from clausewise.operators.labels import encode_fixed
from clausewise.operators.sampling import train_test_split
from clausewise.operators.scoring import gram_cells
from clausewise.operators.stats import term_stats
from clausewise.operators.vocab import containment_vectors, refit_containment_margins
from clausewise.plans import analyse, bow, sequence
from clausewise.plans.bow import KEYS, LABEL_COLS
from clausewise.session import checkpoint_dir, stage
from clausewise.sources.corpus import PERSONAS, class_rules
from clausewise.sources.files import load_stage, save_stage

# Fixed values (our choice): the penalties searched.
L2_GRID = (0.0, 0.1)


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex[:12]}"


def persona_models(penalties: tuple[float, ...] = (0.0,)) -> list[Model]:
    return [Model(p, f"label_{p}", x) for p in PERSONAS for x in penalties]


def bow_training(spark: SparkSession, sf_dir: str, penalties: tuple[float, ...] = (0.0,), folder: str | None = None) -> Training:
    """A run over the selected containment counts, standardised with the training
    clauses' statistics; a term stands for its selected columns in each persona."""
    models = persona_models(penalties)
    units = stage(train_test_split(bow.corpus_units(spark, sf_dir), [], KEYS), "units")
    train = units.where(F.col("split") == "train")
    selected = stage(bow._selected_terms(train, *bow.corpus_sums(train)), "selected")
    wanted = stage(selected.select("term").distinct(), "wanted")
    # cells are made for the selected terms only
    both = stage(containment_vectors(units, wanted, [], KEYS, carry=["split", *LABEL_COLS]).withColumnRenamed("term", "feature"), "features")
    mine = both.where(F.col("split") == "train").select("n", F.col("feature").alias("term"))
    n_train = train.select(F.count(F.lit(1)).cast("long")).scalar()
    columns = [F.max(F.when(F.col("persona") == m.name, F.col("selected_multiplicity")).otherwise(0)).cast("long").alias(f"k_{i}")
               for i, m in enumerate(models)]
    features = term_stats(mine, n_train, []).join(selected.groupBy("term").agg(*columns), "term") \
        .select(F.col("term").alias("feature"), "mean", "std", *[f"k_{i}" for i in range(len(models))])
    return Training(units.select(*KEYS, "split", *LABEL_COLS), both.select(*KEYS, "feature", "n"), stage(features, "statistics"), KEYS, models,
                    folder or run_folder(spark))


def sequence_training(spark: SparkSession, sf_dir: str, penalties: tuple[float, ...] = (0.0,), folder: str | None = None) -> Training:
    """A run over the presence of id n-grams: every n-gram of the training clauses is a
    feature; those of one training clause alone are stored together."""
    models = persona_models(penalties)
    tokens = sequence.token_table(spark, sf_dir)
    rules = class_rules(F.col("quality"), F.col("toxic"))
    labels = [encode_fixed(rules[p]).alias(f"label_{p}") for p in PERSONAS]
    # clauses are numbered once, then stored: cells carry one number instead of the keys
    ids = stage(sequence.table_ids(tokens).withColumn("unit", F.monotonically_increasing_id()), "sequence-ids")
    units = stage(train_test_split(tokens.select(*KEYS, *labels), [], KEYS).join(ids.select(*KEYS, "unit"), KEYS), "sequence-units")
    grams = gram_cells(ids.select("unit", "input_ids").join(units.select("unit", "split"), "unit"), ["unit", "split"])
    cells = merged_columns(grams, "unit", stage)
    features = stage(plain_features(cells.where(F.col("split") == "train"), models), "gram-features")
    return Training(units, cells.drop("split"), features, ["unit"], models, folder or run_folder(spark))


def held_out(training: Training, epoch: int) -> DataFrame:
    """``persona, doc_id, clause_no, label, p1`` of the held-out clauses under the state of an epoch."""
    per = F.inline(F.array(*[F.struct(F.lit(m.name).alias("persona"), F.col(m.label).cast("int").alias("label"),
                                      F.round(f"m_{i}", linear.PLACES).alias("m")) for i, m in enumerate(training.models)]))
    rows = training.margins(epoch).where(F.col("split") == "test").select(*KEYS, per)
    return rows.select("persona", *KEYS, "label", sigmoid(F.col("m")).alias("p1"))


def _scored(rows: DataFrame, score: F.Column, mode: str) -> DataFrame:
    s = decode(rows.withColumn("score", score), mode)
    return s.select("persona", *KEYS, "label", (F.col("p1") > 0.5).cast("int").alias("prediction"),
                    F.transform("score", lambda x: F.round(x, 6)).alias("score"), "class")


def score_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held_out(bow_training(spark, sf_dir).run(), STEPS)
    return _scored(rows, F.array(1 - F.col("p1"), F.col("p1")), "bow")


def score_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held_out(sequence_training(spark, sf_dir).run(), STEPS)
    return _scored(rows, F.array(F.col("p1")), "bert")


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-22 and O-24 after every epoch, per persona, penalty and split (O-43's table)."""
    return sequence_training(spark, sf_dir, L2_GRID).run().metrics().withColumnRenamed("name", "persona")


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: the penalty and epoch of least held-out loss of the bag-of-words models."""
    best = best_epochs(bow_training(spark, sf_dir, L2_GRID).run().metrics())
    return best.select(F.col("name").alias("persona"), F.col("l2").alias("best_reg_param"), F.col("epoch").alias("best_epoch"),
                       F.col("loss").alias("best_loss"))


# --- requests under fitted models ------------------------------------------------

def fitted_weights(spark: SparkSession, sf_dir: str, standardised: bool) -> DataFrame:
    """The bag-of-words models as a stored weight table, saved and loaded (O-06)."""
    training = bow_training(spark, sf_dir).run()
    make = standardised_weights if standardised else linear_weights
    folder = run_folder(spark)
    save_stage(make(training.weights(STEPS), training.models), folder, "fitted_weights")
    return load_stage(spark, folder, "fitted_weights")


def refit_report(spark: SparkSession, sf_dir: str, weights: DataFrame) -> DataFrame:
    """E2 as the reference runs it: each request's counts standardised with the request's
    own mean and deviation, then scored and reported."""
    from clausewise.plans.models import report

    valid = analyse.valid_requests(spark, sf_dir)
    clauses = analyse.request_tokens(spark, sf_dir)
    known = weights.where(F.col("feature") != linear.INTERCEPT).select("persona", F.col("feature").alias("term"), "weight")
    margins = refit_containment_margins(clauses, known, ["persona"], "doc_id", "clause_no")
    return report(linear.by_document(margins, valid, weights), linear.two_logits, "bow")


def analyse_requests_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope ``corpus``: the training statistics folded into the weights."""
    from clausewise.plans.models import score_requests_bow

    return score_requests_bow(spark, sf_dir, fitted_weights(spark, sf_dir, standardised=False))


def analyse_requests_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope ``document``: statistics fitted again on every request."""
    return refit_report(spark, sf_dir, fitted_weights(spark, sf_dir, standardised=True))
