"""O-41..O-43: logistic regression whose weights are a table.

Nothing of a model lies on the driver but scalars: weights are rows ``feature, w_0,
w_1, ..`` (a column per model), clauses are sparse cells ``keys, feature, n``. One
full-batch step is two joins and two sums:

    margins    cells join weights on the feature, summed per clause
    gradient   cells join residuals on the clause, summed per feature (map-side
               first, so a feature in a third of all clauses is a row per task)

For the joins a run stores its cells twice, a row per feature (a frequent one: several) with the
list of its clauses, and a row per clause with the list of its features: a join moves
and sorts a row per feature or clause, not one per cell.

Models over the same clauses (a persona each, several penalties each) share every
pass. A feature has a mean and a deviation: its value in a clause is
``(n - mean) / std``, also where the clause has no cell. The zero cells are never made:
the margin is a constant ``b - sum(v * mean)`` plus ``sum(v * n)`` over the clause's
cells with ``v = k * w / std``, and the gradient is ``(sum(r * n) - mean * sum(r)) /
std``. ``k_0, k_1, ..`` are the numbers of equal columns the feature stands for in each
model (0: the model does not use it).

A run is a folder: ``epoch=K`` below ``weights``, ``margins`` and ``metrics``. The metrics
of an epoch are written last, and an epoch with metrics is done: a run that was
stopped goes on after its last such epoch, whatever half-written files it left, and
gives the same numbers as one that was not (steps are deterministic functions of
the stored tables up to the order of floating sums).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.operators.aggregates import EPS
from clausewise.operators.linear import INTERCEPT, PLACES
from clausewise.session import freed_shuffles

# Defaults of a run (our choice): full-batch steps and step width.
STEPS = 6
RATE = 0.5
# Cells of a feature that stand in one row of its list, about.
LIST_CELLS = 2 ** 14
# Beyond this margin exp() overflows or vanishes; clipped on either side.
MARGIN_LIMIT = 700.0


@dataclass(frozen=True)
class Model:
    """``name`` (a persona), the 0/1 column of the clauses it learns, its penalty."""
    name: str
    label: str
    l2: float = 0.0


def plain_features(cells: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Every feature of ``cells`` as it is: mean 0, deviation 1, one column in every model."""
    return cells.select("feature").distinct().select(
        "feature", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"), *[F.lit(1).cast("long").alias(k) for k in _columns("k", models)])


def merged_columns(cells: DataFrame, unit: str, store) -> DataFrame:
    """``unit, split, feature, n, copies`` (features renamed to numbers) from cells ``unit (BIGINT, not negative), split,
    feature, n = 1``.

    Features that stand in one and the same training clause and in no other are equal
    columns of the training cells: from equal weights every step gives them equal weights.
    They become one feature, ``-1 - unit``, and a cell counts in ``copies`` how many of
    them it has: so many times the one weight enters a margin, while the gradient is that of
    one column. Features without a training cell get no number and drop out: they have no weight.
    ``store`` writes the result to the shared folder and reads it back.
    """
    # one shuffle of the cells: a feature's number is the place of its first row in its partition, the same in every attempt
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.select(unit, "split", "feature").where(F.col("feature").isNotNull()).repartition(width, "feature") \
        .sortWithinPartitions("feature").withColumn("_id", F.monotonically_increasing_id())
    own, train = Window.partitionBy("feature"), F.col("split") == "train"
    rows = rows.select(unit, "split", F.count_if(train).over(own).alias("_c"), F.min(F.when(train, F.col(unit))).over(own).alias("_u"),
                       F.min("_id").over(own).alias("_id")).where("_c > 0")
    number = F.when(F.col("_c") == 1, -1 - F.col("_u")).otherwise(F.col("_id"))
    rows = rows.groupBy(unit, "split", number.alias("feature")).agg(F.count("*").alias("_c"))
    alone, one = F.col("feature") < 0, F.lit(1).cast("long")
    return store(rows.select(unit, "split", F.col("feature").cast("string").alias("feature"), F.when(alone, one).otherwise(F.col("_c")).alias("n"),
                             F.when(alone, F.col("_c")).otherwise(one).alias("copies")), "grams")


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(F.least(F.greatest(-margin, F.lit(-MARGIN_LIMIT)), F.lit(MARGIN_LIMIT))))


def _columns(prefix: str, models: Sequence[Model]) -> list[str]:
    return [f"{prefix}_{i}" for i in range(len(models))]


class Training:
    """A run over ``units`` (keys, split, label columns), ``cells`` (keys, feature, n, and
    ``copies`` where a cell stands for several equal columns, see ``merged_columns``)
    and ``features`` (feature, mean, std, k_0, ..), all stored tables. Cells of features
    that are not listed weigh nothing."""

    def __init__(self, units: DataFrame, cells: DataFrame, features: DataFrame, keys: Sequence[str],
                 models: Sequence[Model], folder: str, rate: float = RATE):
        self.units, self.cells, self.features = units, cells, features
        self.keys, self.models, self.folder, self.rate = list(keys), list(models), folder.rstrip("/"), rate
        self.spark: SparkSession = units.sparkSession
        self.w, self.k, self.m, self.r = (_columns(c, models) for c in "wkmr")

    # --- stored tables ---------------------------------------------------------

    def _path(self, table: str, epoch: int) -> str:
        return f"{self.folder}/{table}/epoch={epoch}"

    def _store(self, df: DataFrame, table: str, epoch: int) -> DataFrame:
        with freed_shuffles(self.spark):
            df.write.mode("overwrite").parquet(self._path(table, epoch))
        return self.spark.read.schema(df.schema).parquet(self._path(table, epoch))

    def weights(self, epoch: int) -> DataFrame:
        """``feature, mean, std, k_0, .., w_0, ..``; the intercept under ''."""
        return self.spark.read.parquet(self._path("weights", epoch))

    def margins(self, epoch: int) -> DataFrame:
        """``keys, split, labels.., m_0, ..`` of every clause."""
        return self.spark.read.parquet(self._path("margins", epoch))

    def metrics(self) -> DataFrame:
        """``name, l2, epoch, split, n_rows, loss, accuracy, c00, c01, c10, c11``."""
        return self.spark.read.parquet(f"{self.folder}/metrics").withColumn("epoch", F.col("epoch").cast("int"))

    def done(self) -> int:
        """The last epoch with metrics, -1 without any."""
        try:
            epochs = self.metrics().where("n_rows > 0").select("epoch").distinct().collect()
        except AnalysisException:
            return -1
        return max((r["epoch"] for r in epochs), default=-1)

    def _lists(self) -> None:
        """``by_feature``: feature, c (keys, n with copies); ``by_unit``: keys, c (feature, n)."""
        n = F.col("n") * F.col("copies") if "copies" in self.cells.columns else F.col("n")
        cells = self.cells.where(F.col("feature").isNotNull())
        # a frequent feature is dealt to several rows: no list grows with the clauses
        parts = F.ceil(F.count("*").over(Window.partitionBy("feature")) / LIST_CELLS)
        lists = cells.select("feature", F.struct(*self.keys, n.alias("n")).alias("c"), F.pmod(F.xxhash64(*self.keys), parts).alias("_part")) \
            .groupBy("feature", "_part").agg(F.collect_list("c").alias("c")).drop("_part")
        self.by_feature = self._store(lists, "by_feature", 0)
        self.by_unit = self._store(cells.groupBy(*self.keys).agg(F.collect_list(F.struct("feature", "n")).alias("c")), "by_unit", 0)

    # --- one epoch -----------------------------------------------------------

    def _start(self) -> DataFrame:
        own = ["feature", "mean", "std", *self.k]
        base = self.spark.range(1).select(F.lit(INTERCEPT).alias("feature"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"),
                                          *[F.lit(1).cast("long").alias(k) for k in self.k])
        return self.features.select(*own).unionByName(base).select("*", *[F.lit(0.0).alias(w) for w in self.w])

    def _margins(self, weights: DataFrame) -> DataFrame:
        real = F.col("feature") != INTERCEPT
        v = [F.col(k) * F.col(w) / F.col("std") for k, w in zip(self.k, self.w, strict=True)]
        consts = weights.agg(*[F.sum(F.when(real, -x * F.col("mean")).otherwise(F.col(w))) for x, w in zip(v, self.w, strict=True)]).first()
        known = weights.where(real).select("feature", *[x.alias(c) for x, c in zip(v, self.m, strict=True)])
        rows = self.by_feature.join(known, "feature").select(F.inline("c"), *self.m)
        sums = rows.groupBy(*self.keys).agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in self.m])
        return self.units.join(sums, self.keys, "left").select(
            *self.units.columns, *[(F.coalesce(F.col(c), F.lit(0.0)) + F.lit(k)).alias(c) for c, k in zip(self.m, consts, strict=True)])

    def _residuals(self, margins: DataFrame) -> DataFrame:
        return margins.where(F.col("split") == "train").select(
            *self.keys, *[(sigmoid(F.col(f"m_{i}")) - F.col(x.label)).alias(f"r_{i}") for i, x in enumerate(self.models)])

    def _next(self, weights: DataFrame, margins: DataFrame) -> DataFrame:
        res = self._residuals(margins)
        n, *total = res.agg(F.count("*"), *[F.sum(c) for c in self.r]).first()
        rows = self.by_unit.join(res, self.keys).select(F.inline("c"), *self.r)
        grad = rows.groupBy("feature").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in self.r])
        real = F.col("feature") != INTERCEPT
        new = []
        for i, (model, w, s) in enumerate(zip(self.models, self.w, total, strict=True)):
            mine = (F.coalesce(F.col(f"r_{i}"), F.lit(0.0)) - F.col("mean") * F.lit(float(s or 0.0))) / F.col("std")
            step = F.when(real, mine / F.lit(max(n, 1)) + F.lit(model.l2) * F.col(w)).otherwise(F.lit(float(s or 0.0)) / F.lit(max(n, 1)))
            new.append((F.col(w) - F.lit(self.rate) * step).alias(w))
        return weights.join(grad, "feature", "left").select("feature", "mean", "std", *self.k, *new)

    def _metrics(self, margins: DataFrame) -> DataFrame:
        per = F.inline(F.array(*[F.struct(F.lit(x.name).alias("name"), F.lit(x.l2).alias("l2"), F.col(x.label).cast("int").alias("y"),
                                          sigmoid(F.round(f"m_{i}", PLACES)).alias("p")) for i, x in enumerate(self.models)]))
        p = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1.0 - EPS))
        y, guess = F.col("y"), (F.col("p") > 0.5).cast("int")
        # index 0 is the class of label 1, as in the confusion matrix of evaluate
        counts = {"c00": (1, 1), "c01": (1, 0), "c10": (0, 1), "c11": (0, 0)}
        return margins.select("split", per).groupBy("name", "l2", "split").agg(
            F.count("*").alias("n_rows"), F.avg(-F.ln(F.when(y == 1, p).otherwise(1 - p))).alias("loss"),
            F.avg((y == guess).cast("double")).alias("accuracy"),
            *[F.count_if((y == a) & (guess == b)).alias(c) for c, (a, b) in counts.items()])

    def run(self, steps: int = STEPS) -> Training:
        """Goes on to epoch ``steps``; epochs that are done are not repeated."""
        at = self.done()
        if at < steps:
            self._lists()
        if at < 0:
            self._finish(self._store(self._start(), "weights", 0), 0)
            at = 0
        while at < steps:
            weights = self._store(self._next(self.weights(at), self.margins(at)), "weights", at + 1)
            at += 1
            self._finish(weights, at)
        return self

    def _finish(self, weights: DataFrame, epoch: int) -> None:
        margins = self._store(self._margins(weights), "margins", epoch)
        self._store(self._metrics(margins), "metrics", epoch)


def best_epochs(metrics: DataFrame, split: str = "test") -> DataFrame:
    """O-43: per model name the state of least held-out loss; ties go to the smaller
    penalty, then to the earlier epoch."""
    return metrics.where(F.col("split") == split).groupBy("name").agg(
        F.min_by(F.struct("l2", "epoch", "loss", "accuracy"), F.struct(F.round("loss", 9), "l2", "epoch")).alias("b")) \
        .select("name", "b.*")


def _per_model(weights: DataFrame, models: Sequence[Model]) -> DataFrame:
    per = F.inline(F.array(*[F.struct(F.lit(m.name).alias("persona"), F.col(f"k_{i}").alias("k"), F.col(f"w_{i}").alias("w"))
                             for i, m in enumerate(models)]))
    return weights.select("feature", "mean", "std", per).where("k > 0")


def linear_weights(weights: DataFrame, models: Sequence[Model]) -> DataFrame:
    """The weight table of ``operators.linear`` for cells as they are (``persona, feature,
    weight``): deviations divide the weights, means move into the intercepts."""
    rows = _per_model(weights, models).withColumn("v", F.col("k") * F.col("w") / F.col("std"))
    real = F.col("feature") != INTERCEPT
    base = rows.groupBy("persona").agg(F.sum(F.when(real, -F.col("v") * F.col("mean")).otherwise(F.col("w"))).alias("weight"))
    return rows.where(real).select("persona", "feature", F.col("v").alias("weight")).unionByName(
        base.select("persona", F.lit(INTERCEPT).alias("feature"), "weight"))


def standardised_weights(weights: DataFrame, models: Sequence[Model]) -> DataFrame:
    """``persona, feature, weight`` for standardised values: all equal columns of a feature together."""
    return _per_model(weights, models).select("persona", "feature", (F.col("k") * F.col("w")).alias("weight"))
