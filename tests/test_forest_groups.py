"""A forest on groups of rows with the same bins is a forest of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.operators import models as MD


def _rows(spark, n=6000):
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) for i in range(3)]
    label = ((h[0] + F.when(h[1] < 50, 0).otherwise(40) + h[2] % 7) > 70).cast("int")
    return spark.range(n).select(F.col("id").alias("mail_id"), label.alias("label"), (h[0] % 9).cast("double").alias("x"),
                                 (h[1] >= 50).cast("double").alias("y"), (h[2] % 7).cast("double").alias("z"),
                                 F.lit(1.0).alias("same")).checkpoint()


def test_a_pass_of_a_forest_costs_groups(spark, monkeypatch):
    """Every tree is fitted on few rows, whose counts add up to about all of them."""
    rows, cols, seen = _rows(spark), ["x", "y", "z", "same"], []

    class Kept(MD.RandomForestClassifier):
        def fit(self, df):
            if self.isSet("weightCol"):
                seen.append(df.agg(F.count("*"), F.sum(self.getWeightCol())).first())
            return super().fit(df)
    monkeypatch.setattr(MD, "RandomForestClassifier", Kept)
    on_rows = MD.fit_predict("RF", rows, rows, cols, {"numTrees": 12})
    assert not seen
    monkeypatch.setattr(MD, "FOREST_ROWS", 1)
    monkeypatch.setattr(MD, "LEAST_ROWS", 8)
    on_groups = MD.fit_predict("RF", rows, rows, cols, {"numTrees": 12})
    assert len(seen) == 12 and len({w for _, w in seen}) > 1
    assert all(n <= 2 * 9 * 2 * 7 and abs(w - 6000) < 500 for n, w in seen)
    right = F.avg((F.col("y_pred") == F.col("label")).cast("double"))
    a, b = on_rows.agg(right).first()[0], on_groups.agg(right).first()[0]
    assert abs(a - b) < 0.02 and b > 0.6
    both = on_rows.select("mail_id", F.col("y_prob").alias("p")).join(on_groups, "mail_id")
    assert both.count() == 6000 and both.agg(F.avg(F.abs(F.col("p") - F.col("y_prob")))).first()[0] < 0.05


def test_rows_that_share_no_bins_are_fitted_themselves(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_ROWS", 1)
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), *[
        (F.xxhash64("id", F.lit(i)) / 1e18).alias(c) for i, c in enumerate("abcd")])
    model = MD.fit_forest(rows, list("abcd"), 3, 5, 1)
    assert len(model.stages[-1].trees) == 3 and model.stages[0].getInputCols() == list("abcd")


def test_values_that_the_library_refuses_are_refused(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_ROWS", 1)
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") > 3, F.col("id") % 5).alias("a"))
    with pytest.raises(Exception, match="NaN"):
        MD.fit_forest(rows, ["a"], 3, 5, 1)


def test_borders_are_midpoints_or_equal_shares():
    assert MD._borders(np.array([3.0, 1.0, np.nan, 1.0])) == [2.0]
    assert MD._borders(np.array([5.0, 5.0])) == [] and MD._borders(np.array([np.nan])) == []
    many = MD._borders(np.arange(3200.0))
    assert len(many) == MD.BINS - 1 and abs(many[0] - 99.5) <= 1 and abs(np.diff(many) - 100).max() <= 1
