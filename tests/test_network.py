"""The network's passes against finite differences and the library's model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.operators import models as MD
from mailspark.operators import network


def test_network_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    x, y, layers = rng.normal(size=(1500, 4)), rng.integers(0, 2, 1500), [4, 5, 3, 2]
    w = rng.normal(size=5 * 5 + 6 * 3 + 4 * 2)
    loss, grad = network.gradient(x, y, w, layers)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-5
        slope = (network.gradient(x, y, w + e, layers)[0] - network.gradient(x, y, w - e, layers)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-4 * max(1.0, abs(slope))
    assert loss > 0
    for wrong in (-1, 2):
        with pytest.raises(ValueError):
            network.gradient(x, np.where(y > 0, wrong, y), w, layers)


def test_network_is_trained_over_dealt_rows_and_is_the_librarys_model(spark, monkeypatch):
    """Rows of one part are dealt to tasks; the library fits no rows itself, its model has the trained weights."""
    fitted, parts, real = [], [], network.blocks

    class Watched(MD.MultilayerPerceptronClassifier):
        def fit(self, rows):
            fitted.append((self.getMaxIter(), rows.count()))
            return super().fit(rows)
    monkeypatch.setattr(MD, "MultilayerPerceptronClassifier", Watched)
    monkeypatch.setattr(MD, "ROUND_ROWS", 100)
    monkeypatch.setattr(network, "blocks", lambda rows: parts.append(rows.rdd.getNumPartitions()) or real(rows))
    rows = spark.range(600).select(F.col("id").alias("mail_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                   (F.col("id") % 3 + F.col("id") % 7 / 10.0).alias("a"), (F.col("id") % 5 - 2.0).alias("b")).coalesce(1)
    rows = MD._vec(rows, ["a", "b"]).select("mail_id", "label", "features")
    model, history = MD.fit_mlp(rows, [2, 6, 2], {**MD.DEFAULTS["MLP"], "maxIter": 100}, 42)
    assert parts == [6, 6] and fitted == [(0, 1)] * 2
    assert max(h[2] for h in history) == 1.0 and sum(h[3] for h in history) == 1
    out = model.transform(rows)
    assert out.where(F.col("prediction") != F.col("label")).count() == 0
    held = network.blocks(rows)
    value, grad = network.mean_loss(held, [2, 6, 2])(model.weights.toArray())
    p = F.element_at(MD.vector_to_array("probability"), F.col("label") + 1)
    assert abs(out.agg(F.avg(-F.log(p))).first()[0] - value) < 1e-9


def test_network_steps_reach_the_minimum():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 30))
    m, at = m @ m.T + np.eye(30), rng.normal(size=30)
    w, taken = network.descend(lambda w: (float((w - at) @ m @ (w - at)) + 1.0, 2 * m @ (w - at)), np.zeros(30), 300, 1e-12)
    assert taken < 300 and np.abs(w - at).max() < 1e-3
