"""O-41..O-43 as weight tables: a run equals plain loops, resumes where it stopped,
and its margins equal the dense computation with all zeros written out."""

import math
import os

import pytest
from pyspark.sql import functions as F

from clausewise.operators import descent, linear
from clausewise.operators.descent import Model, Training
from clausewise.operators.scoring import gram_cells
from clausewise.session import stage

UNITS = [(i, i % 2, int(i % 3 == 0), "test" if i % 5 == 4 else "train") for i in range(20)]
CELLS = [(i, f, (i * j) % 4) for i in range(20) for j, f in enumerate("abcde", 1) if (i * j) % 4]
FEATURES = [(f, 0.5 * j, 1.0 + j, j % 3, 1) for j, f in enumerate("abcd")]  # e is not a feature


def start(spark, folder, models=None):
    units = spark.createDataFrame(UNITS, "id long, y long, z long, split string")
    cells = spark.createDataFrame(CELLS, "id long, feature string, n long")
    features = spark.createDataFrame(FEATURES, "feature string, mean double, std double, k_0 long, k_1 long")
    return Training(stage(units, "u"), stage(cells, "c"), stage(features, "f"), ["id"],
                    models or [Model("one", "y"), Model("two", "z", 0.3)], folder, rate=0.7)


def dense(label, model, l2, steps, rate=0.7):
    n = {(i, f): v for i, f, v in CELLS}
    z = {(u[0], f): (n.get((u[0], f), 0) - mean) / std for u in UNITS for f, mean, std, *_ in FEATURES}
    k = {f: ks[model] for f, _, _, *ks in FEATURES}
    w, b = dict.fromkeys(k, 0.0), 0.0
    margin = lambda i: b + sum(k[f] * w[f] * z[i, f] for f in k)
    train = [u for u in UNITS if u[3] == "train"]
    for _ in range(steps):
        r = {u[0]: 1 / (1 + math.exp(-margin(u[0]))) - u[label] for u in train}
        grad = {f: sum(r[i] * z[i, f] for i in r) / len(r) + l2 * w[f] for f in k}
        b, w = b - rate * sum(r.values()) / len(r), {f: w[f] - rate * grad[f] for f in k}
    return {u[0]: margin(u[0]) for u in UNITS}


def test_margins_equal_dense_loops(spark, scratch):
    t = start(spark, scratch).run(4)
    got = {r.id: r for r in t.margins(4).collect()}
    for i, label, l2 in ((0, 1, 0.0), (1, 2, 0.3)):
        want = dense(label, i, l2, 4)
        assert {j: round(r[f"m_{i}"], 9) for j, r in got.items()} == {j: round(m, 9) for j, m in want.items()}


def test_loss_falls_and_every_epoch_has_its_confusion_matrix(spark, scratch):
    rows = start(spark, scratch).run(3).metrics().orderBy("name", "split", "epoch").collect()
    assert len(rows) == 2 * 2 * 4
    for name in ("one", "two"):
        losses = [r.loss for r in rows if r.name == name and r.split == "train"]
        assert losses == sorted(losses, reverse=True) and losses[0] == pytest.approx(math.log(2))
    assert all(r.c00 + r.c01 + r.c10 + r.c11 == r.n_rows for r in rows)
    best = {r.name: r for r in descent.best_epochs(start(spark, scratch).metrics()).collect()}
    held = [r for r in rows if r.split == "test" and r.name == "one"]
    assert best["one"].epoch == min(held, key=lambda r: (round(r.loss, 9), r.l2, r.epoch)).epoch


def test_a_stopped_run_goes_on_and_gives_the_same_numbers(spark, scratch, monkeypatch):
    whole, broken = f"{scratch}/whole", f"{scratch}/broken"
    want = start(spark, whole).run(4)
    t = start(spark, broken)
    real, calls = Training._metrics, []

    def fails(self, margins):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(self, margins)
    monkeypatch.setattr(Training, "_metrics", fails)
    with pytest.raises(RuntimeError):
        t.run(4)  # weights and margins of epoch 2 are written, its metrics are not
    monkeypatch.setattr(Training, "_metrics", real)
    os.makedirs(f"{broken}/weights/epoch=3/_temporary")  # what a killed writer leaves
    again = start(spark, broken)
    assert again.done() == 1
    stamp = os.path.getmtime(f"{broken}/weights/epoch=1/_SUCCESS")
    again.run(4)
    assert os.path.getmtime(f"{broken}/weights/epoch=1/_SUCCESS") == stamp  # epoch 1 was not repeated
    key = lambda t: sorted((r.name, r.epoch, r.split, round(r.loss, 12), r.c00) for r in t.metrics().collect())
    assert key(again) == key(want)
    assert again.run(4).done() == 4 and again.run(2).done() == 4


def test_folded_weights_give_the_margins_of_the_run(spark, scratch):
    t = start(spark, scratch).run(3)
    weights = descent.linear_weights(t.weights(3), t.models)
    cells = t.cells.select(F.lit("one").alias("persona"), "id", "feature", "n")
    sums = {r.id: r.margin for r in linear.margins(cells, weights, ["id"]).collect()}
    base = weights.where("persona = 'one' and feature = ''").first().weight
    for r in t.margins(3).collect():
        assert r.m_0 == pytest.approx(base + sums.get(r.id, 0.0))
    assert "a" not in {r.feature for r in weights.where("persona = 'one'").collect()}  # k_0 = 0


def test_empty_tables(spark, scratch):
    none = lambda s: spark.createDataFrame([], s)
    t = Training(none("id long, y long, split string"), none("id long, feature string, n long"),
                 none("feature string, mean double, std double, k_0 long"), ["id"], [Model("m", "y")], scratch).run(2)
    assert t.margins(2).count() == 0 and t.weights(2).count() == 1


def test_refit_margins_equal_the_dense_document(spark):
    docs = {1: [{"a": 2}, {"a": 1, "b": 1}, {}], 2: [{"b": 3}], 3: [{"a": 1}, {"a": 1}], 4: [{"zz": 1}]}
    w = {"a": 0.75, "b": -1.5}
    cells = spark.createDataFrame([("p", d, i, f, n) for d, cs in docs.items() for i, c in enumerate(cs) for f, n in c.items()],
                                  "persona string, doc_id long, clause_no long, feature string, n long")
    sizes = spark.createDataFrame([("p", d, len(cs)) for d, cs in docs.items()], "persona string, doc_id long, n_units long")
    weights = spark.createDataFrame([("p", f, x) for f, x in w.items()] + [("p", "", 9.0)], "persona string, feature string, weight double")
    parts = {(r.doc_id, r.clause_no): r.margin for r in linear.refit_margins(cells, sizes, weights).collect()}
    for d, cs in docs.items():
        for i, c in enumerate(cs):
            want = 0.0
            for f, x in w.items():
                col = [k.get(f, 0) for k in cs]
                mean = sum(col) / len(col)
                std = math.sqrt(sum((v - mean) ** 2 for v in col) / len(col)) or 1.0
                want += x * (c.get(f, 0) - mean) / std
            assert parts.get((d, i), 0.0) + parts.get((d, linear.WHOLE), 0.0) == pytest.approx(want, abs=1e-12)


def test_grams_are_distinct_windows(spark):
    ids = spark.createDataFrame([(1, [5, 6, 5, 6, 7]), (2, [4]), (3, [])], "id long, input_ids array<int>")
    got = {}
    for r in gram_cells(ids, ["id"]).collect():
        got.setdefault(r.id, []).append(r.feature)
    seq = [5, 6, 5, 6, 7]
    want = {" ".join(map(str, seq[i:i + w])) for w in (2, 3, 4) for i in range(len(seq) - w + 1)}
    assert set(got) == {1} and sorted(got[1]) == sorted(want)
