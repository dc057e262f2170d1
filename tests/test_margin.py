"""The classifiers of all calibration parts, fitted together, against the library's one by one."""

import numpy as np
from pyspark.sql import functions as F

from mailspark.operators import margin
from mailspark.operators import models as MD


def _rows(spark, n=3000):
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(3)]
    return spark.range(0, n, 1, 3).select(F.col("id").alias("mail_id"), h[0].alias("a"), h[1].alias("b"),
                                          (h[0] * h[0] + h[1] + h[2] * 0.2 > 0.9).cast("int").alias("label")).checkpoint()


def test_hinge_gradient_is_the_slope_and_leaves_the_own_part_out(spark):
    rows = _rows(spark, 600).withColumn("fold", (F.col("mail_id") % 3).cast("int"))
    rdd = margin.blocks(rows, ["a", "b"], lambda x: np.column_stack([x, x[:, 0] * x[:, 1]]))
    n, spread = margin._moments(rdd, 3)
    assert n.tolist() == [200, 200, 200] and spread[-1] == 0 and abs(spread[0] - 0.29) < 0.03
    at, rng = margin.hinge(rdd, 3, np.array([2.0, 3.0, 1.0, 1.0]), 1.0, n), np.random.default_rng(4)
    w = rng.normal(size=12)
    value, grad = at(w)
    held = rows.select("a", "b", "label", "fold").toArrow()
    x, y, f = (np.column_stack([held["a"], held["b"]]), np.where(np.array(held["label"]) > 0, 1, -1), np.array(held["fold"]))
    z, v = np.column_stack([x, x[:, 0] * x[:, 1], np.ones(600)]), w.reshape(3, 4) * [2.0, 3.0, 1.0, 1.0]
    want = sum(np.maximum(0, 1 - y * (z @ v[i]))[f != i].mean() + (v[i, :3] ** 2).sum() / 800 for i in range(3))
    assert abs(value - want) < 1e-5
    for i in range(12):
        e = np.zeros(12)
        e[i] = 1e-3
        assert abs((at(w + e)[0] - at(w - e)[0]) / 2e-3 - grad[i]) < 2e-2


def test_margin_of_many_rows_is_the_librarys(spark, monkeypatch):
    rows, p = _rows(spark), {"n_components": 24, "calibration_cv": 3}
    one_by_one = MD.fit_predict("SVM", rows, rows, ["a", "b"], p).select("mail_id", F.col("y_prob").alias("p"), F.col("y_pred").alias("q")).checkpoint()

    def refused(*_):
        raise AssertionError("the library fits no classifier")
    monkeypatch.setattr(MD, "PASS_ROWS", 1)
    monkeypatch.setattr(MD.LinearSVC, "fit", refused)
    monkeypatch.setattr(margin, "STEP_ROWS", 20)
    out = MD.fit_predict("SVM", rows, rows, ["a", "b"], p)
    assert "y_prob" in out.columns and "features" not in out.columns
    both = out.join(one_by_one, "mail_id")
    right = [F.avg((F.col(c) == F.col("label")).cast("double")) for c in ("y_pred", "q")]
    n, mine, theirs, far = both.agg(F.count("*"), *right, F.avg(F.abs(F.col("p") - F.col("y_prob")))).first()
    assert n == 3000 and mine > 0.9 and abs(mine - theirs) < 0.02 and far < 0.03
    assert out.where(F.col("y_pred") != (F.col("y_prob") > 0.5).cast("int")).count() == 0


def test_rows_with_nulls_go_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(MD, "PASS_ROWS", 1)
    rows = _rows(spark, 200)
    assert MD._plain(rows, ["a", "b"])
    assert not MD._plain(rows.withColumn("a", F.when(F.col("a") > 0.5, F.col("a"))), ["a", "b"])
    assert not MD._plain(rows.withColumn("label", F.lit(1)), ["a", "b"]) and not MD._plain(rows.withColumn("label", F.lit(2)), ["a", "b"])
