"""Over many rows the network is trained by passes of small steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.operators import models as MD
from mailspark.operators import network


def _rows(spark, n=3000):
    rows = spark.range(0, n, 1, 3).select(F.col("id").alias("mail_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                          (F.col("id") % 3 + F.col("id") % 7 / 10.0 - 1).alias("a"), (F.col("id") % 5 - 2.0).alias("b"))
    return MD._vec(rows, ["a", "b"]).select("mail_id", "label", "features").checkpoint()


def test_a_pass_takes_every_row_once_and_averages_by_rows(spark, monkeypatch):
    held, layers = network.blocks(_rows(spark, 1000)), [2, 5, 2]
    weights = np.random.default_rng(1).normal(size=27)
    state = network.start(weights)
    after = network.small_steps(held, state, layers, 7)
    loss = network.mean_loss(held, layers)
    # steps of 200 rows, the last ones of a matrix a little larger: one or two a part of 333 rows
    assert 1 <= after[3] <= 2 and np.abs(after[0] - weights).max() > 1e-4
    again = network.small_steps(held, state, layers, 7)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(after, again))
    monkeypatch.setattr(network, "RATE", 0.0)
    assert np.allclose(network.small_steps(held, state, layers, 7)[0], weights)
    monkeypatch.undo()
    for _ in range(150):
        state = network.small_steps(held, state, layers, 7)
    assert loss(state[0])[0] < 0.5 * loss(weights)[0]
    with pytest.raises(ValueError):
        network.small_steps(held.filter(lambda _: False), state, layers, 7)


def test_a_network_of_many_rows_needs_few_passes(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("no pass for a single step")
    monkeypatch.setattr(MD, "PASS_ROWS", 1)
    monkeypatch.setattr(network, "descend", refused)
    monkeypatch.setattr(network, "STEP_ROWS", 10)
    rows = _rows(spark)
    model, history = MD.fit_mlp(rows, [2, 8, 2], {**MD.DEFAULTS["MLP"], "maxIter": 40}, 42)
    assert [h[:2] for h in history] == [(i, i + 1) for i in range(len(history))] and len(history) <= 40
    assert sum(h[3] for h in history) == 1 and max(h[2] for h in history) > 0.95
    assert model.transform(rows).where(F.col("prediction") != F.col("label")).count() < 150
