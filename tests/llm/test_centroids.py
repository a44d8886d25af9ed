"""Walsh-Hadamard centroid clustering against a plain-loop version in Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from clausewise.llm import centroids as C

NAN, INF = float("nan"), float("inf")


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept)
    cents = [v for _, v in order[:k]]
    best = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(best(v)[1], []).append(v)
        cents = [[sum(x) // len(x) for x in zip(*mine[j])] if j in mine else c for j, c in enumerate(cents)]
    got = [(i, best(v)) for i, v in kept]
    per = {}
    for _, (d, j) in got:
        per[j] = per.get(j, 0) + d
    long = lambda d: d if d < 2 ** 63 else None
    return sorted(((i, j, long(d), long(per[j]), long(sum(per.values())),
                    hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, (d, j) in got), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int")
    got = C.cluster(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_equals_plain_loops_with_defective_rows_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.126, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, None), (401, []), (402, [0.5] * 63), (403, [NAN] * 64),
             (404, [INF] + [0.0] * 63), (405, [None] + [0.0] * 63), (406, [0.0] * 64), (407, [0.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_huge_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 9, 30]) for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(40)]
    got = run(spark, rows)
    assert any(r[2] is None for r in got) and all(r[4] is None for r in got)
    assert got == brute(rows)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, None)]) == [] and run(spark, []) == []


def test_transform_keeps_distances_and_eliminates_nothing_nearest():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-50, 50, (200, 64)), rng.integers(-50, 50, (16, 64))
    c[5] = c[3]
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (((C.transform(v)[:, None] - C.transform(c)[None]) ** 2).sum(2) == 64 * d).all()
    cluster, best = C.nearest(v, c)
    assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()
    changes = (np.diff(C.transform(np.eye(64, dtype=np.int64)).T, axis=1) != 0).sum(1)
    assert changes.tolist() == list(range(64))


def test_slices_of_a_batch_are_all_rows(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(C, "ROWS", 7)  # in this process
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (50, 64))
    x[13] *= 1e9
    centroids = [[int(v) for v in np.floor(64 * r)] for r in x[:5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"]).slice(3, 40)
    rows = [r for b in C._labels(centroids, 64)(iter([batch])) for r in b.to_pylist()]
    exact = [[C.exact_floor(float(e), 64) for e in r] for r in x]
    want = {i: min((sum((a - b) ** 2 for a, b in zip(exact[i], c)), j) for j, c in enumerate(centroids)) for i in range(3, 43)}
    assert {r["id"]: r["cluster"] for r in rows} == {i: j for i, (_, j) in want.items()}
    assert {r["id"]: r["distance"] for r in rows} == {i: d if d < 2 ** 63 else None for i, (d, _) in want.items()}
    parts = [r for b in C._sums(centroids, 64)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["part"] for r in parts if r["dim"] < 0) == 40
    total = sum(r["part"] << (32 * r["limb"]) for r in parts if r["dim"] == 5)
    assert total == sum(exact[i][5] for i in range(3, 43))
