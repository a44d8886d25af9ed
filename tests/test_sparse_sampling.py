"""O-30 and O-21 on sparse counts, and O-29 by column, against dense plain loops."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clausewise.operators import sparse_sampling as S
from clausewise.operators.stats import select_columns, select_top_k
from clausewise.session import stage

TERMS = "abcdefgh"
MULT = {t: 1 + i for i, t in enumerate(TERMS)}


def corpus(seed, n):
    rng = random.Random(seed)
    rows = {f"r{i}": {t: rng.randrange(1, 4) for t in TERMS if rng.random() < .4} for i in range(n)}
    rows["r0"], rows["r1"], rows["r2"] = {}, {}, dict(rows["r3"])  # empty twice, a copy
    return {i: c | {"h": 2} for i, c in rows.items()}  # h is constant


def weights(rows):
    n, out = len(rows), {}
    for t in TERMS:
        v = [c.get(t, 0) for c in rows.values()]
        spread = n * sum(x * x for x in v) - sum(v) ** 2
        out[t] = S.WEIGHT_UNIT * MULT[t] if spread == 0 else S.WEIGHT_UNIT * MULT[t] * n * n // spread
    return out


def tables(spark, rows, scope_of):
    cells = spark.createDataFrame([(i, t, n) for i, c in rows.items() for t, n in c.items()], "id string, term string, n long")
    sums = cells.groupBy("term").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("total_sq")) \
        .join(spark.createDataFrame(list(MULT.items()), "term string, multiplicity long"), "term")
    w = stage(S.column_weights(sums, F.lit(len(rows))).withColumn("number", F.monotonically_increasing_id()), "w")
    units = spark.createDataFrame([(scope_of(i), i) for i in rows], "p string, id string")
    return cells, w, stage(S.sparse_points(units, cells, w, "p", "id"), "points")


def brute_knn(rows, scope_of, k):
    w, out = weights(rows), {}
    for i, a in rows.items():
        near = sorted((sum(w[t] * (a.get(t, 0) - b.get(t, 0)) ** 2 for t in TERMS), j) for j, b in rows.items()
                      if j != i and scope_of(i) == scope_of(j))
        out[i] = [(j, d) for d, j in near[:k]]
    return out


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_neighbours_are_exact_whatever_the_blocks(spark, block):
    rows, scope_of = corpus(block, 60), lambda i: "xy"[int(i[1:]) % 2]
    cells, w, points = tables(spark, rows, scope_of)
    assert {r.term: r.weight for r in w.collect()} == weights(rows)
    got = {}
    for r in S.sparse_knn(points, stage, 4, block).orderBy("id", "nb_rank").collect():
        got.setdefault(r.id, []).append((r.nb_id, r.dist2))
    assert got == brute_knn(rows, scope_of, 4)


def test_far_blocks_are_not_compared(spark):
    # two clouds of very different norms: with small blocks no pair of clouds meets
    rows = {f"s{i:02}": {"a": 1, "b": i % 2} for i in range(20)} | {f"l{i:02}": {"a": 900, "c": 100 + i % 2} for i in range(20)}
    cells, w, points = tables(spark, rows, lambda i: "p")
    blocked, blocks = S.norm_blocks(points.withColumn("id", F.col("id").cast("string")), 10)
    assert blocks.count() >= 4
    seen = []

    def store(df, name):
        out = stage(df, name)
        if name == "knn-pairs":
            seen.extend((r.qb, r.rb) for r in out.collect())
        return out
    got = {}
    for r in S.sparse_knn(points, store, 3, 10).orderBy("id", "nb_rank").collect():
        got.setdefault(r.id, []).append((r.nb_id, r.dist2))
    assert got == brute_knn(rows, lambda i: "p", 3)
    side = {r.block: {x.id[0] for x in blocked.where(F.col("block") == r.block).collect()} for r in blocks.collect()}
    assert all(side[a] == side[b] for a, b in seen) and len(seen) < blocks.count() * (blocks.count() - 1)


def test_products_beyond_doubles_are_exact(spark):
    import pandas as pd
    big = 2 ** 27
    r = pd.DataFrame({"id": ["a", "b", "c"], "t": [[1, 2], [1], [2]], "n": [[big, 1], [big + 1], [3]],
                      "wn": [[big, 1], [big + 1], [3]]})
    r["norm2"] = [sum(x * y for x, y in zip(n, wn)) for n, wn in zip(r["n"], r["wn"])]
    got = {(i, j): d for i, j, d in S._nearest(r, r, 2).itertuples(index=False)}
    assert got["a", "b"] == 2 and got["a", "c"] == big ** 2 + 4


def test_segments_cells_and_moments(spark):
    rows, scope_of = corpus(5, 30), lambda i: "p"
    cells, w, points = tables(spark, rows, scope_of)
    near = stage(S.sparse_knn(points, stage, 5, 8), "near")
    need = spark.createDataFrame([("p", len(rows), 71)], "scope string, n long, g long")
    segs = stage(S.segments(points.select("scope", "id"), need, near), "segs")
    made = segs.collect()
    assert len(made) == 71 and all(0 <= r.h < 2 ** 32 for r in made)
    known = {i: {j for j, _ in v} for i, v in brute_knn(rows, scope_of, 5).items()}
    assert all(r.nb_id in known[r.base_id] for r in made)
    want, s, q = {}, {}, {}
    for r in made:
        lam = Fraction(r.h, 2 ** 32)
        for t in TERMS:
            v = rows[r.base_id].get(t, 0) + lam * (rows[r.nb_id].get(t, 0) - rows[r.base_id].get(t, 0))
            if v:
                want[r.base_id, r.sample_no, t] = float(v)
            s[t], q[t] = s.get(t, 0) + v, q.get(t, 0) + v * v
    got = {(r.base_id, r.sample_no, r.term): r.value for r in S.cells_of(segs, cells).collect()}
    assert got == want
    for r in S.moments_after(segs, cells).collect():
        assert (int(r.s), int(r.q)) == (s[r.term] * 2 ** 32, q[r.term] * 2 ** 64)


def test_synthetic_id_arrays_are_cut_to_integers(spark):
    arrays = {"a": [5, 9, 2], "b": [8], "c": []}
    segs = [("p", x, 1, y, h) for x in arrays for y in arrays for h in (0, 1, 2 ** 31, 2 ** 32 - 1)]
    got = S.arrays_of(spark.createDataFrame(segs, "scope string, base_id string, sample_no long, nb_id string, h long"),
                      spark.createDataFrame(list(arrays.items()), "id string, input_ids array<int>")).collect()
    want = []
    for _, x, _, y, h in segs:
        a, b = arrays[x], arrays[y]
        pad = lambda v: v + [0] * (max(len(a), len(b)) - len(v))
        want.append((x, y, [int(p + Fraction(h, 2 ** 32) * (q - p)) for p, q in zip(pad(a), pad(b))]))
    assert sorted((r.base_id, r.nb_id, r.input_ids) for r in got) == sorted(want)


def test_anova_after_equals_dense_anova(spark):
    rows = corpus(6, 40)
    label = {i: int(int(i[1:]) % 4 == 0) for i in rows}
    cells, w, points = tables(spark, {i: c for i, c in rows.items()}, lambda i: "p")
    minor = stage(points.where(F.col("id").isin(*[i for i in rows if label[i]])), "minor")
    n0, n1 = sum(1 - v for v in label.values()), sum(label.values())
    need = spark.createDataFrame([("p", n1, n0 - n1)], "scope string, n long, g long")
    segs = stage(S.segments(minor.select("scope", "id"), need, S.sparse_knn(minor, stage, 5, 8)), "segs")
    obs = [("p", t, sum(c.get(t, 0) for i, c in rows.items() if not label[i]), sum(c.get(t, 0) for i, c in rows.items() if label[i]),
            sum(c.get(t, 0) ** 2 for c in rows.values())) for t in TERMS]
    sizes = spark.createDataFrame([("p", n0, n1, 1, n0 - n1)], "p string, n0 long, n1 long, minor int, g long")
    got = {r.term: r.f for r in S.anova_after(spark.createDataFrame(obs, "p string, term string, s0 long, s1 long, q long"),
                                              S.moments_after(segs, cells).withColumnRenamed("scope", "p"), sizes, ["p"]).collect()}
    for t in TERMS:
        a = [Fraction(c.get(t, 0)) for i, c in rows.items() if not label[i]]
        b = [Fraction(c.get(t, 0)) for i, c in rows.items() if label[i]]
        for r in segs.collect():
            x, y = rows[r.base_id].get(t, 0), rows[r.nb_id].get(t, 0)
            b.append(x + Fraction(r.h, 2 ** 32) * (y - x))
        both = a + b
        mean = sum(both) / len(both)
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in (a, b))
        inside = sum((v - sum(g) / len(g)) ** 2 for g in (a, b) for v in g)
        if inside == 0:
            assert got[t] is None if between == 0 else math.isinf(got[t])
        else:
            assert got[t] == pytest.approx(float(between / (inside / (len(both) - 2))), rel=1e-9)


def test_columns_of_equal_f_interleave_by_position(spark):
    # x, y and z tie; their columns lie at alternating positions
    f = {"top": 9.0, "x": 4.0, "y": 4.0, "z": 4.0, "low": 1.0, "none": None}
    pos = [(t, d, c, p) for d in range(12) for c, (t, p) in enumerate([("x", 0), ("y", 1), ("z", d % 3), ("low", 3)]) if (d + c) % 3]
    pos += [("top", 1, 0, 0), ("top", 2, 0, 0), ("none", 3, 0, 0)]
    count = {t: sum(r[0] == t for r in pos) for t in f}
    scored = spark.createDataFrame([(s, t, v, count[t]) for s in "ab" for t, v in f.items()], "p string, term string, f double, multiplicity long")
    columns = spark.createDataFrame(pos, "term string, o1 long, o2 long, o3 long")
    order = sorted(pos, key=lambda r: (-(f[r[0]] if f[r[0]] is not None else -1), -r[1], -r[2], -r[3]))
    for k in (1, 2, 3, 9, 20, len(pos) - 1, len(pos), 99):
        want = {}
        for t, *_ in order[:k]:
            want[t] = want.get(t, 0) + 1
        got = select_columns(scored, columns, ["p"], k).collect()
        for s in "ab":
            assert {r.term: r.selected_multiplicity for r in got if r.p == s} == want, k
    # the rule by term takes whole terms instead
    by_term = select_top_k(scored.withColumn("o", F.lit(0)), ["p"], 9, ["o"]).where("p = 'a'").collect()
    assert {r.term: r.selected_multiplicity for r in by_term} != {r.term: r.selected_multiplicity for r in select_columns(
        scored, columns, ["p"], 9).where("p = 'a'").collect()}


def test_blocks_meet_in_rounds_of_few_copies(spark):
    rows, scope_of = corpus(5, 60), lambda i: "xy"[int(i[1:]) % 2]
    cells, w, points = tables(spark, rows, scope_of)
    stored = {}

    def store(df, name):
        stored[name] = stage(df, name)
        return stored[name]
    got = {}
    for r in S.sparse_knn(points, store, 4, 3, round_copies=1).orderBy("id", "nb_rank").collect():
        got.setdefault(r.id, []).append((r.nb_id, r.dist2))
    assert got == brute_knn(rows, scope_of, 4)
    turns, filled = stored["knn-turns"], stored["knn-filled"].count()
    assert {(r.scope, r.qb, r.rb) for r in turns.collect()} == {(r.scope, r.qb, r.rb) for r in stored["knn-pairs"].collect()}
    met = [r["count"] for r in turns.groupBy("turn").count().collect()]
    assert len(met) > 2 and max(met) <= 2 * filled
    assert sum(name.startswith("knn-best") for name in stored) == len(met)


def test_shuffle_files_of_a_stage_are_gone_after_it(spark):
    from clausewise.session import _FREE_SHUFFLES, freed_shuffles

    before = spark.conf.get(_FREE_SHUFFLES)
    with freed_shuffles(spark):
        assert spark.conf.get(_FREE_SHUFFLES) == "true"
    assert spark.conf.get(_FREE_SHUFFLES) == before
    with pytest.raises(ZeroDivisionError), freed_shuffles(spark):
        1 / 0
    assert spark.conf.get(_FREE_SHUFFLES) == before
