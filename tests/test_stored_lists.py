"""Training over lists of cells stored per feature and per clause."""

import pytest
from pyspark.sql import functions as F

from clausewise.operators import descent
from clausewise.operators.descent import Model, Training
from clausewise.session import stage


def test_a_frequent_feature_is_dealt_to_several_lists(spark, scratch, monkeypatch):
    monkeypatch.setattr(descent, "LIST_CELLS", 8)
    units = stage(spark.createDataFrame([(i, i % 2, "test" if i % 5 == 4 else "train") for i in range(60)], "id long, y long, split string"), "u")
    cells = stage(spark.createDataFrame([(i, f, 1 + i % 3, 1 + i % 2) for i in range(60) for f in ("all", f"f{i % 7}")],
                                        "id long, feature string, n long, copies long"), "c")
    features = stage(descent.plain_features(cells, [Model("m", "y")]), "f")
    t = Training(units, cells, features, ["id"], [Model("m", "y")], scratch).run(2)
    lists = t.by_feature.select("feature", F.size("c").alias("n")).collect()
    assert sum(r.feature == "all" for r in lists) > 3 and sum(r.n for r in lists) == 120
    assert t.by_unit.count() == 60
    # a margin is the sum of its cells' weights, copies included
    w = {r.feature: r.w_0 for r in t.weights(2).collect()}
    for r in t.margins(2).collect():
        assert r.m_0 == pytest.approx(w[""] + (1 + r.id % 3) * (1 + r.id % 2) * (w["all"] + w[f"f{r.id % 7}"]))
