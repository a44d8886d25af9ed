"""O-30 above a size: recall of the random-projection buckets against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import approx_knn as A
from clausewise.operators.sampling import exact_knn, smote
from clausewise.plans import resample
from clausewise.session import stage


def points(spark, x, scope=None):
    rows = [(i, [float(e) for e in v], int(scope[i]) if scope is not None else 0) for i, v in enumerate(x)]
    return stage(spark.createDataFrame(rows, "id long, vec array<double>, s long"), "points")


def test_recall_on_the_embeddings(spark):
    pts = resample.labelled_points(spark, "/root/testdata/sf0.1")
    found = stage(A.approximate_knn(pts, stage, bucket_rows=300), "found")
    exact = exact_knn(pts)
    assert A.recall(found, exact) >= 0.9
    assert found.where("id = nb_id").count() == 0 and found.groupBy("id", "nb_id").count().where("count > 1").count() == 0


def test_recall_on_clusters_and_scopes(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (40, 24))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 1, (3000, 24))
    pts = points(spark, x, rng.integers(0, 2, 3000))
    found = stage(A.approximate_knn(pts, stage, scope_col="s", bucket_rows=100), "found")
    assert A.recall(found, exact_knn(pts, scope_col="s"), ("s", "id")) >= 0.9


def test_few_points_are_exact_and_none_are_none(spark):
    x = np.random.default_rng(2).normal(0, 1, (60, 8))
    pts = points(spark, x)
    key = lambda df: sorted((r.id, r.nb_id, r.nb_rank) for r in df.collect())
    assert key(A.approximate_knn(pts, stage)) == key(exact_knn(pts))
    assert A.approximate_knn(pts.where("id < 0"), stage).count() == 0


def test_a_tight_cluster_and_equal_points_stay_linear(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (400, 8)), 50 + rng.normal(0, 1e-3, (900, 8)), np.full((900, 8), -40.0)])
    pts = points(spark, x)
    sizes = []

    def store(df, name):
        out = stage(df, name)
        if name in ("lsh-hot", "lsh-equal"):
            sizes.append(out.count())
        return out
    found = stage(A.approximate_knn(pts, store, bucket_rows=50), "found")
    assert sizes[0] > 0 and sizes[1] > 0
    assert found.groupBy("id").count().where("count < 5").count() == 0
    equal = found.where("id >= 1300")
    assert equal.agg(F.max("dist")).first()[0] == 0.0


@pytest.mark.parametrize("above", [10 ** 9, 20])
def test_smote_takes_either_search(spark, above):
    rng = np.random.default_rng(4)
    rows = [(int(i % 5 == 0), i, [float(e) for e in rng.normal(0, 1, 6)]) for i in range(300)]
    pts = spark.createDataFrame(rows, "label long, id long, vec array<double>")
    made = smote(pts, approximate_above=above, store=stage)
    assert made.count() == 180
    want = {tuple(r) for r in smote(pts).select("base_id", "sample_no", "nb_id").collect()}
    assert {tuple(r) for r in made.select("base_id", "sample_no", "nb_id").collect()} == want  # a bucket holds 60 rows


def test_a_block_measures_many_rows_at_once_and_floats_stay_floats(spark, monkeypatch):
    import pandas as pd

    from clausewise.operators import sampling

    x = np.random.default_rng(3).integers(0, 2, (600, 6)).astype(float)  # many ties
    pdf = pd.DataFrame({"scope": 0, "id": np.arange(600), "vec": list(x)})
    calls = []
    root = np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda v: (calls.append(len(v)), root(v))[1])
    got = sampling._knn_block(3)(pdf, pdf)
    assert len(calls) <= 5 and max(calls) <= sampling.PAIRS
    monkeypatch.setattr(sampling, "PAIRS", 50)
    pd.testing.assert_frame_equal(sampling._knn_block(3)(pdf, pdf), got)
    d = root(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert (got["nb_id"].to_numpy().reshape(-1, 3) == want).all() and (got["dist"].to_numpy().reshape(-1, 3) == np.take_along_axis(d, want, 1)).all()

    kept = {}
    rows = points(spark, x).withColumn("vec", F.col("vec").cast("array<float>"))
    A.approximate_knn(rows, lambda df, name: (kept.update({name: df.schema}), stage(df, name))[1])
    assert kept["lsh-points"]["vec"].dataType.simpleString() == "array<float>"
