"""What a fit holds of its rows does not grow with the fits side by side or with the planner's parts."""

from pyspark.sql import functions as F

from mailspark.operators import models as MD


def _rows(spark, n=240):
    return spark.range(n).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"),
                                 (F.col("id") % 2 + F.col("id") % 7 / 10.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"),
                                 F.floor(F.col("id") / 2 % 2).cast("int").alias("fold"))


def test_svm_fits_run_one_after_another_where_rows_are_many(spark, monkeypatch):
    seen, run = [], MD.in_parallel
    monkeypatch.setattr(MD, "in_parallel", lambda fits, most=MD.PARALLEL_FITS: seen.append(most) or run(fits, most))
    monkeypatch.setattr(MD, "HELD_BYTES", 1)
    fitted, fit = [], MD._svm_fit
    monkeypatch.setattr(MD, "_svm_fit", lambda a, b, p: fitted.append(a.storageLevel.useMemory) or fit(a, b, p))
    out = MD.cv_predictions(_rows(spark), ["x", "y"], "SVM", "A", "G", k=2, params={"n_components": 8, "calibration_cv": 2})
    assert out.count() == 240 and out.where(F.col("y_pred") == F.col("y_true")).count() == 240
    assert set(seen) == {1} and len(seen) == 3 and fitted == [False] * 4
    assert MD.side_by_side(100, 256) == 1


def test_fits_are_side_by_side_up_to_the_bytes_they_hold():
    assert MD.side_by_side(1000, 256) == MD.PARALLEL_FITS
    assert MD.side_by_side(150_000, 256) == 3
    assert MD.side_by_side(9_000_000, 256) == 1


def test_forest_rows_are_dealt_by_the_bytes_of_a_part(spark, monkeypatch):
    rows = _rows(spark).coalesce(1)
    assert MD._forest_rows(rows, 10).rdd.getNumPartitions() == 1
    monkeypatch.setattr(MD, "FOREST_BYTES", 240 * 280 // 40)
    parts = MD._forest_rows(rows, 10)
    assert parts.rdd.getNumPartitions() == 40 and parts.count() == 240
    assert max(r.n for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 12
    assert len(MD.fit_pipeline(rows, ["x", "y"], 3, 3, 1).stages[-1].trees) == 3
