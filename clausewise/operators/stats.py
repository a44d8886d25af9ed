"""O-20 scaler fit, O-28 standardise, O-21 ANOVA F, O-29 top-k selection.

All statistics come from sums over the non-zero cells plus the number of
units (clauses) per scope; zero cells are counted through that number and
never materialised.

Exactness: sums are integers, so the two quantities whose sign or zero-ness
decides an edge case are formed exactly in DECIMAL(38,0):

* scaler:  N*sum(n^2) - sum(n)^2      (zero -> deviation 0 -> replaced by 1)
* ANOVA:   d = S0*n1 - S1*n0           (zero -> no between-class spread)
           w = Q*n0*n1 - S0^2*n1 - S1^2*n0   (zero -> no within-class spread)

For two classes F = (SSB/1) / (SSW/(N-2)) = d^2 (N-2) / (N w), so F is +inf
exactly when w = 0 < |d| (ranked first) and undefined (NULL, ranked last)
when both are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEC = "decimal(38,0)"

# Fixed value: number of columns kept by the ANOVA selection.
TOP_K = 12000


def scope_sizes(units: DataFrame, scope: Sequence[str], label_col: str | None = None) -> DataFrame:
    """``scope..., n_units[, n0, n1]``: one row per scope (tiny)."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n_units")]
    if label_col:
        aggs += [F.count_if(F.col(label_col) == 0).cast("long").alias("n0"),
                 F.count_if(F.col(label_col) == 1).cast("long").alias("n1")]
    return units.groupBy(*scope).agg(*aggs)


def term_stats(cells: DataFrame, sizes, scope: Sequence[str]) -> DataFrame:
    """O-20: ``scope..., term, total, total_sq, n_units, mean, std, z0``.

    ``sizes``: a table ``scope..., n_units``, or with an empty scope a scalar
    column holding the number of units.

    Population deviation (divide by N); a zero deviation is replaced by 1.
    """
    return stats_from_sums(cells.groupBy(*scope, "term").agg(
        F.sum("n").cast("long").alias("total"),
        F.sum(F.col("n") * F.col("n")).cast("long").alias("total_sq")), sizes, scope)


def stats_from_sums(sums: DataFrame, sizes, scope: Sequence[str]) -> DataFrame:
    """``term_stats`` from ``scope..., term, total, total_sq``."""
    if scope:
        s = sums.join(sizes.select(*scope, "n_units"), list(scope))
    else:
        # one corpus-wide N: a scalar subquery column, never a join on a
        # constant key (which the optimizer turns into a cartesian product)
        s = sums.withColumn("n_units", sizes)
    n = F.col("n_units").cast(DEC)
    spread = n * F.col("total_sq").cast(DEC) - F.col("total").cast(DEC) * F.col("total").cast(DEC)
    nd = F.col("n_units").cast("double")
    mean = F.col("total").cast("double") / nd
    std = F.when(spread == 0, F.lit(1.0)).otherwise(F.sqrt(spread.cast("double")) / nd)
    return (s.withColumn("mean", mean)
             .withColumn("std", std)
             .withColumn("z0", -F.col("mean") / F.col("std")))


def standardise(cells: DataFrame, stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """O-28: adds ``z = (n - mean) / std`` to the non-zero cells."""
    st = stats.select(*scope, "term", "mean", "std")
    return with_z(cells.join(st, [*scope, "term"]))


def with_z(cells: DataFrame) -> DataFrame:
    """Replaces a cell's ``mean`` and ``std`` by its ``z``."""
    return (cells.withColumn("z", (F.col("n").cast("double") - F.col("mean")) / F.col("std"))
                 .drop("mean", "std"))


def label_sums(cells: DataFrame, scope: Sequence[str], label_cols: Sequence[str]) -> DataFrame:
    """``scope..., term, total, q, s1_<label>...``: sums of n, n^2, and n where the
    label is 1, for several labels of the same cells in one aggregate."""
    return cells.groupBy(*scope, "term").agg(
        F.sum("n").cast("long").alias("total"), F.sum(F.col("n") * F.col("n")).cast("long").alias("q"),
        *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).cast("long").alias(f"s1_{c}") for c in label_cols])


def anova_f(cells: DataFrame, sizes: DataFrame, scope: Sequence[str], label_col: str = "label") -> DataFrame:
    """O-21: one-way ANOVA F of each term's column against a 0/1 label.

    ``cells`` must carry the label of its clause; ``sizes`` gives n0, n1.
    """
    s1 = F.col(f"s1_{label_col}")
    sums = label_sums(cells, scope, [label_col]).select(*scope, "term", (F.col("total") - s1).alias("s0"), s1.alias("s1"), "q")
    return anova_from_sums(sums, sizes, scope)


def anova_from_sums(sums: DataFrame, sizes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """F from ``scope..., term, s0, s1, q`` (sums by label and of squares)."""
    s = sums.join(sizes.select(*scope, "n0", "n1"), list(scope))
    n0, n1 = F.col("n0").cast(DEC), F.col("n1").cast(DEC)
    s0, s1, q = F.col("s0").cast(DEC), F.col("s1").cast(DEC), F.col("q").cast(DEC)
    d = s0 * n1 - s1 * n0
    w = q * n0 * n1 - s0 * s0 * n1 - s1 * s1 * n0
    nn = (F.col("n0") + F.col("n1")).cast("double")
    dd = F.col("d").cast("double")
    f = (F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.lit(None).cast("double"))
          .when((F.col("w") == 0) & (F.col("d") == 0), F.lit(None).cast("double"))
          .when(F.col("w") == 0, F.lit(float("inf")))
          .otherwise((dd * dd * (nn - F.lit(2.0))) / (nn * F.col("w").cast("double"))))
    return (s.withColumn("d", d).withColumn("w", w).withColumn("f", f)
             .select(*scope, "term", "s0", "s1", "q", "f"))


F_BUCKETS = 4096


def _f_cell(f: Column) -> Column:
    """A cell number that grows with F: linear in log2(F), NULL lowest, infinity highest."""
    c = F.floor((F.log2(F.greatest(f, F.lit(2.0 ** -64))) + 64) * (F_BUCKETS / 192)).cast("int")
    return (F.when(f.isNull(), F.lit(-1)).when(f == F.lit(float("inf")), F.lit(F_BUCKETS))
            .otherwise(F.least(F.greatest(c, F.lit(0)), F.lit(F_BUCKETS - 1))))


def _above_threshold(scored: DataFrame, scope: Sequence[str], k: int) -> DataFrame:
    tagged = scored.withColumn("_cell", _f_cell(F.col("f")))
    hist = tagged.groupBy(*scope, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*scope).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = (hist.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0))).where(F.col("_above") < k)
             .groupBy(*scope).agg(F.min("_cell").alias("_least")))
    return tagged.join(least, list(scope)).where(F.col("_cell") >= F.col("_least")).drop("_cell", "_least")


def select_top_k(scored: DataFrame, scope: Sequence[str], k: int = TOP_K,
                 tie_cols: Sequence[str] = ()) -> DataFrame:
    """O-29: keep the best columns by F until their multiplicity reaches k.

    ``scored``: ``scope..., term, f, multiplicity, tie_cols...``. Order is F
    descending (NULL last), then the later column first (``tie_cols``
    descending). The last kept term may be cut: ``selected_multiplicity``.

    Before the window, a histogram of F (in F's own order, at most
    ``F_BUCKETS`` cells per scope) gives the cell in which the k-th row lies, and
    only rows at or above that cell go on: the window of a scope receives k rows
    and that cell's, not k rows from every map task.
    """
    order = [F.col("f").desc_nulls_last(), *[F.col(c).desc() for c in tie_cols], F.col("term").desc()]
    w = Window.partitionBy(*scope).orderBy(*order)
    if scope:
        scored = _above_threshold(scored, scope, k)
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    cum = F.sum("multiplicity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (top.withColumn("_before", cum - F.col("multiplicity"))
               .where(F.col("_before") < k)
               .withColumn("selected_multiplicity",
                           F.least(F.col("multiplicity"), F.lit(k) - F.col("_before")).cast("long"))
               .withColumn("rank", F.col("rank").cast("long"))
               .drop("_before"))


POSITION_BUCKETS = 4096


def select_columns(scored: DataFrame, columns: DataFrame, scope: Sequence[str], k: int = TOP_K,
                   store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """O-29 column by column: the k columns of largest F, of equal ones the later column first.

    ``scored``: ``scope..., term, f, multiplicity`` (one row for a term's equal columns);
    ``columns``: ``term`` and the position of each of its columns (``o1, o2, o3``, shared by
    the scopes). Where the k-th column lies among several terms of one F, their columns
    interleave by position, so a term may be cut anywhere. Returns ``scope..., term,
    f, multiplicity, selected_multiplicity``.

    Terms above the tie need no columns. Inside it a histogram of the positions finds
    the cell with the last column that gets in, and only that cell is ranked. ``store``
    (as ``session.stage``) keeps the tied terms and their columns, which are read several
    times: all columns meet the tied terms once, and without a shuffle where these are few.
    """
    store = store or (lambda df, name: df)
    s = scored.withColumn("_fk", F.coalesce(F.col("f"), F.lit(-1.0)))  # F is never negative: undefined ranks last
    s = _above_threshold(s, scope, k)
    groups = s.groupBy(*scope, "_fk").agg(F.sum("multiplicity").alias("_m"))
    cum = F.sum("_m").over(Window.partitionBy(*scope).orderBy(F.col("_fk").desc()).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_before", F.coalesce(cum, F.lit(0))).where(F.col("_before") < k) \
        .withColumn("_room", F.least(F.col("_m"), F.lit(k) - F.col("_before")))
    s = store(s.join(groups, [*scope, "_fk"]), "select-terms")
    whole = s.where("_room = _m").withColumn("selected_multiplicity", F.col("multiplicity").cast("long"))
    tied = store(s.where("_room < _m").select(*scope, "term", "_room"), "select-ties")

    pos = store(columns.select("term", "o1", "o2", "o3").join(tied, "term"), "select-columns")
    ends = pos.groupBy(*scope).agg(F.min("o1").alias("_lo"), F.max("o1").alias("_hi"))
    cell = F.floor((F.col("o1") - F.col("_lo")).cast("double") * POSITION_BUCKETS / (F.col("_hi") - F.col("_lo") + 1).cast("double"))
    pos = pos.join(ends, list(scope)).withColumn("_cell", cell.cast("int")).drop("_lo", "_hi")
    hist = pos.groupBy(*scope, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.first("_room").alias("_room"))
    later = F.sum("_n").over(Window.partitionBy(*scope).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1))
    hist = hist.withColumn("_left", F.col("_room") - F.coalesce(later, F.lit(0))).where("_left > 0").select(*scope, "_cell", "_left", "_n")
    pos = pos.join(hist, [*scope, "_cell"])
    rank = F.row_number().over(Window.partitionBy(*scope, "_cell").orderBy(F.desc("o1"), F.desc("o2"), F.desc("o3")))
    last = pos.where("_left < _n").withColumn("_rank", rank).where("_rank <= _left").select(*scope, "term")
    took = pos.where("_left >= _n").select(*scope, "term").unionByName(last).groupBy(*scope, "term").agg(
        F.count(F.lit(1)).cast("long").alias("selected_multiplicity"))
    out = [*scope, "term", "f", "multiplicity", "selected_multiplicity"]
    return whole.select(*out).unionByName(s.where("_room < _m").join(took, [*scope, "term"]).select(*out))
