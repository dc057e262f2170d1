"""Trees grown in tasks are the library's: splits, leaves, written form."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from mailspark.operators import forest
from mailspark.operators import models as MD


def _rows(spark, n=4000):
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) for i in range(3)]
    label = ((h[0] + F.when(h[1] < 50, 0).otherwise(40) + h[2] % 7) > 70).cast("int")
    return spark.range(n).select(F.col("id").alias("mail_id"), label.alias("label"), (h[0] / 3.0).alias("x"),
                                 (h[1] >= 50).cast("int").alias("y"), (h[2] % 7).cast("double").alias("z")).checkpoint()


def _gini(c):
    return 1.0 - ((c / c.sum()) ** 2).sum() if c.sum() else 0.0


def _grown(n=60, classes=3, depth=30, least=1, seed=1):
    rng = np.random.default_rng(seed)
    x, y, w = rng.integers(0, 9, (n, 1)).astype(np.uint8), rng.integers(0, classes, n), rng.poisson(3.0, n).astype(float)
    return x, y, w, forest.grow(x, y, w, classes, depth, least, np.random.default_rng(seed))


def test_every_split_is_the_best_one_of_its_rows():
    for seed in range(5):
        x, y, w, tree = _grown(seed=seed, least=4)
        rows = {0: np.arange(len(x))}
        for i, f in enumerate(tree["feature"]):
            at, c = rows[i], np.bincount(y[rows[i]], weights=w[rows[i]], minlength=3)
            assert (tree["counts"][i] == c).all() and c.sum() >= 4
            best = 0.0
            for b in range(8):
                left = np.bincount(y[at], weights=w[at] * (x[at, 0] <= b), minlength=3)
                if min(left.sum(), (c - left).sum()) >= 4:
                    best = max(best, _gini(c) - (left.sum() * _gini(left) + (c - left).sum() * _gini(c - left)) / c.sum())
            if f >= 0:
                assert abs(best - tree["gain"][i]) < 1e-12
                rows[tree["left"][i]], rows[tree["left"][i] + 1] = at[x[at, 0] <= tree["bin"][i]], at[x[at, 0] > tree["bin"][i]]
        says = tree["counts"].argmax(axis=1)
        pairs = tree["left"][tree["feature"] >= 0]
        assert all(says[a] != says[a + 1] for a in pairs if tree["feature"][a] < 0 and tree["feature"][a + 1] < 0)


def test_trees_end_at_their_depth_and_nodes_are_taken_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 32, (3000, 4)).astype(np.uint8), rng.integers(0, 2, 3000)
    whole = forest.grow(x, y, np.ones(3000), 2, 30, 1, np.random.default_rng(1))
    assert len(whole["feature"]) > 500
    monkeypatch.setattr(forest, "NODES", 3)
    for tree in (forest.grow(x, y, np.ones(3000), 2, 30, 1, np.random.default_rng(1)), whole):
        end = tree["feature"] < 0
        assert (tree["left"][~end] > np.flatnonzero(~end)).all() and tree["counts"][end].sum() == 3000
    assert len(forest.grow(x, y, np.ones(3000), 2, 0, 1, rng)["feature"]) == 1
    assert len(forest.grow(x, y, np.ones(3000), 2, 2, 1, rng)["feature"]) <= 7
    assert len(forest.grow(x, y, np.zeros(3000), 2, 5, 1, rng)["feature"]) == 1


def test_a_forest_of_many_rows_runs_no_job_a_level(spark, monkeypatch, tmp_path):
    rows, cols = _rows(spark), ["x", "y", "z"]
    on_rows = MD.fit_predict("RF", rows, rows, cols, {"numTrees": 12})

    def refused(*_):
        raise AssertionError("the library fits no tree")
    monkeypatch.setattr(MD, "TREE_ROWS", 1)
    monkeypatch.setattr(MD, "FOREST_ROWS", 1 << 40)
    monkeypatch.setattr(MD.RandomForestClassifier, "fit", refused)
    in_tasks = MD.fit_predict("RF", rows, rows, cols, {"numTrees": 12})
    right = F.avg((F.col("y_pred") == F.col("label")).cast("double"))
    a, b = on_rows.agg(right).first()[0], in_tasks.agg(right).first()[0]
    assert abs(a - b) < 0.03 and b > 0.9
    both = on_rows.select("mail_id", F.col("y_prob").alias("p")).join(in_tasks, "mail_id")
    assert both.count() == 4000 and both.agg(F.avg(F.abs(F.col("p") - F.col("y_prob")))).first()[0] < 0.05
    # the served forest: leaves of five rows, written and read back
    model = MD.fit_pipeline(rows, cols, 7, 6, 5)
    last = model.stages[-1]
    assert model.stages[0].getInputCols() == cols and len(last.trees) == last.getNumTrees == 7 and last.getMinInstancesPerNode() == 5
    assert last.numClasses == 2 and last.numFeatures == 3 and max(t.depth for t in last.trees) <= 6
    assert abs(last.featureImportances.toArray().sum() - 1) < 1e-9
    counts = [t._java_obj.rootNode().impurityStats().stats() for t in last.trees]
    assert len({tuple(c) for c in counts}) > 1 and all(abs(sum(c) - 4000) < 400 for c in counts)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    p = MD.vector_to_array("probability")[1].alias("p")
    assert model.transform(rows).select("mail_id", p).exceptAll(again.transform(rows).select("mail_id", p)).count() == 0


def test_labels_and_values_that_the_library_refuses_are_refused(spark, monkeypatch):
    monkeypatch.setattr(MD, "TREE_ROWS", 1)
    monkeypatch.setattr(MD, "FOREST_ROWS", 1)
    rows = spark.range(400).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 5).cast("double").alias("a"))
    for label in (F.lit(-1.0), F.lit(0.5), F.lit(None).cast("double")):
        with pytest.raises(Exception):
            MD.fit_forest(rows.withColumn("label", F.when(F.col("a") > 3, label).otherwise(F.col("label"))), ["a"], 3, 5, 1)
    with pytest.raises(Exception, match="NaN"):
        MD.fit_pipeline(rows.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), ["a"], 3, 5, 1)
    assert len(MD.fit_pipeline(rows, ["a"], 3, 5, 1).stages[-1].trees) == 3
