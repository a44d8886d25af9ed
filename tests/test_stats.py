"""C3/C4: scaler statistics, ANOVA F and the top-k budget on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from clausewise.operators.stats import anova_f, scope_sizes, select_top_k, standardise, term_stats

# dense fixture: 6 clauses x 4 terms; labels; term 'c' constant, 'd' separates perfectly
DENSE = {
    "a": [1, 0, 2, 0, 3, 1],
    "b": [0, 0, 1, 0, 0, 0],
    "c": [2, 2, 2, 2, 2, 2],
    "d": [0, 0, 0, 4, 4, 4],
}
LABELS = [0, 0, 0, 1, 1, 1]


def _cells(spark):
    rows = [("p", i, LABELS[i], t, v) for t, col in DENSE.items() for i, v in enumerate(col) if v]
    cells = spark.createDataFrame(rows, "scope string, clause_no long, label int, term string, n long")
    units = spark.createDataFrame([("p", i, LABELS[i]) for i in range(6)], "scope string, clause_no long, label int")
    return cells, units


def test_term_stats_population_std_and_zero_rule(spark):
    cells, units = _cells(spark)
    got = {r.term: r for r in term_stats(cells, scope_sizes(units, ["scope"]), ["scope"]).collect()}
    for t, col in DENSE.items():
        x = np.array(col, dtype=float)
        std = x.std() or 1.0
        assert math.isclose(got[t].mean, x.mean(), rel_tol=1e-12)
        assert math.isclose(got[t].std, std, rel_tol=1e-12)
        assert math.isclose(got[t].z0, -x.mean() / std, rel_tol=1e-12, abs_tol=1e-12)
    assert got["c"].std == 1.0  # constant column: deviation 0 replaced by 1


def test_standardise_nonzero_cells(spark):
    cells, units = _cells(spark)
    st = term_stats(cells, scope_sizes(units, ["scope"]), ["scope"])
    z = {(r.term, r.clause_no): r.z for r in standardise(cells, st, ["scope"]).collect()}
    x = np.array(DENSE["a"], dtype=float)
    assert math.isclose(z[("a", 4)], (3 - x.mean()) / x.std(), rel_tol=1e-12)


def _f_reference(col, labels):
    x = np.array(col, dtype=float)
    y = np.array(labels)
    groups = [x[y == k] for k in (0, 1)]
    grand = x.mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    if ssw == 0:
        return None if ssb == 0 else math.inf
    return ssb / (ssw / (len(x) - 2))


def test_anova_f(spark):
    cells, units = _cells(spark)
    got = {r.term: r.f for r in anova_f(cells, scope_sizes(units, ["scope"], "label"), ["scope"]).collect()}
    for t, col in DENSE.items():
        ref = _f_reference(col, LABELS)
        if ref is None or math.isinf(ref):
            assert got[t] == ref, t
        else:
            assert math.isclose(got[t], ref, rel_tol=1e-9), t
    assert got["c"] is None and got["d"] == math.inf


def test_top_k_budget_counts_multiplicity(spark):
    rows = [("p", "t1", 9.0, 3, 1), ("p", "t2", 5.0, 2, 2), ("p", "t3", 5.0, 4, 3), ("p", "t4", None, 1, 4),
            ("p", "t5", float("inf"), 1, 5)]
    scored = spark.createDataFrame(rows, "scope string, term string, f double, multiplicity long, last long")
    got = select_top_k(scored, ["scope"], k=7, tie_cols=["last"]).orderBy("rank").collect()
    # inf first, then 9, then the tie 5/5 broken by the later last column (t3 before t2)
    assert [(r.term, r.selected_multiplicity) for r in got] == [("t5", 1), ("t1", 3), ("t3", 3)]


def test_tied_columns_are_met_once(spark):
    from clausewise.operators.stats import select_columns
    from clausewise.session import stage

    rows = [("p", f"t{i}", 2.0 if i == 0 else 1.0, 3) for i in range(6)]  # t0 first, the others tie
    scored = spark.createDataFrame(rows, "persona string, term string, f double, multiplicity long")
    columns = spark.createDataFrame([(f"t{i}", [[j, i, 0] for j in range(3)]) for i in range(6)], "term string, at array<array<long>>") \
        .select("term", F.explode("at").alias("at")).select("term", *[F.col("at")[i].alias(f"o{i + 1}") for i in range(3)])
    names = []
    got = select_columns(scored, columns, ["persona"], 9, lambda df, name: (names.append(name), stage(df, name))[1])
    assert names.count("select-columns") == 1
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # the columns are read once, not at every step
    found = {r["term"]: r["selected_multiplicity"] for r in got.collect()}
    assert found == {"t0": 3, **{f"t{i}": 1 for i in range(1, 6)}} | {"t5": 2}
    assert found == {r["term"]: r["selected_multiplicity"] for r in select_columns(scored, columns, ["persona"], 9).collect()}
