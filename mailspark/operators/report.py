"""2.K: analytics over the experiment ``results`` table.

All sections are window / group-by queries over a table with one row per
(dataset, model_name, feature_group).  ``pos`` (the row's position in the
matrix) breaks ties the way "first maximum" does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailspark.operators import metrics as M

# --- fixed values: published accuracy / F1 of the original study ----------
PAPER_BASELINE = [
    ("A", "RF", 0.998, 0.998), ("A", "SVM", 0.991, 0.991), ("A", "MLP", 0.989, 0.988),
    ("A", "KNN", 0.985, 0.984), ("A", "Stacking", 0.997, 0.997),
    ("B", "RF", 0.962, 0.959), ("B", "SVM", 0.947, 0.943), ("B", "MLP", 0.951, 0.948),
    ("B", "KNN", 0.938, 0.935), ("B", "Stacking", 0.960, 0.957),
]
KEY_COLUMNS = ["dataset", "model_name", "feature_group", "n_features", "accuracy", "precision", "recall",
               "f1", "auc", "brier_score", "ece", "train_time_s", "inference_ms_per_1k"]
# ---------------------------------------------------------------------------


def paper_baseline(spark: SparkSession) -> DataFrame:
    """K5: the published values as a relation (dataset letter A/B)."""
    return spark.createDataFrame(PAPER_BASELINE, "dataset string, model_name string, accuracy double, f1 double")


def dataset_letter(c):
    """T7: 'dataset_A', 'A', 'a' -> 'A' (the join key of the paper lookup)."""
    return F.upper(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([A-Za-z])$", 1))


def with_position(results: DataFrame, order=("dataset", "feature_group", "model_name")) -> DataFrame:
    """Add ``pos`` when absent (results are small: one row per matrix cell)."""
    if "pos" in results.columns:
        return results
    return results.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def extended_table(results: DataFrame, digits: int = 4) -> DataFrame:
    """K1: fixed column order (available only), doubles rounded, and
    ``is_best_accuracy`` per (dataset, model) compared after rounding."""
    cols = [c for c in KEY_COLUMNS if c in results.columns]
    t = M.rounded(results.select(*cols), digits, settle=12)
    w = Window.partitionBy("dataset", "model_name")
    return t.withColumn("is_best_accuracy", F.col("accuracy") == F.max("accuracy").over(w))


def best_accuracy(results: DataFrame, paper: DataFrame) -> DataFrame:
    """K2: best row per dataset (first on ties) and delta to the paper's best."""
    r = with_position(results)
    w = Window.partitionBy("dataset").orderBy(F.desc("accuracy"), "pos")
    best = r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    pb = paper.groupBy(dataset_letter("dataset").alias("_letter")).agg(F.max("accuracy").alias("paper_best"))
    best = best.withColumn("_letter", dataset_letter("dataset")).join(pb, "_letter", "left").drop("_letter")
    return best.select("dataset", "model_name", "feature_group", "accuracy", "paper_best",
                       (F.col("accuracy") - F.col("paper_best")).alias("delta_vs_paper"))


def fastest_within(results: DataFrame, tolerance: float = 0.01, time_col: str = "inference_ms_per_1k") -> DataFrame:
    """K3: among rows within ``tolerance`` of the dataset's best accuracy, the
    one with the smallest inference time (first on ties)."""
    r = with_position(results)
    best = F.max("accuracy").over(Window.partitionBy("dataset"))
    r = r.withColumn("best_accuracy", best).where(F.col("accuracy") >= F.col("best_accuracy") - tolerance)
    w = Window.partitionBy("dataset").orderBy(F.col(time_col), "pos")
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1") \
        .select("dataset", "model_name", "feature_group", time_col, "accuracy", "best_accuracy")


def calibration_extremes(results: DataFrame, columns=("brier_score", "ece")) -> DataFrame:
    """K4: best (min) and worst (max) row per calibration metric, NaN/null
    skipped, first on ties."""
    r = with_position(results)
    out = None
    for c in columns:
        v = r.where(F.col(c).isNotNull() & ~F.isnan(c))
        for kind, order in (("best", F.asc(c)), ("worst", F.desc(c))):
            row = v.withColumn("_rn", F.row_number().over(Window.orderBy(order, "pos"))).where("_rn = 1") \
                .select(F.lit(c).alias("metric"), F.lit(kind).alias("kind"), F.col(c).alias("value"),
                        "model_name", "feature_group", "dataset")
            out = row if out is None else out.unionByName(row)
    return out


def best_baseline_accuracy(baseline: DataFrame) -> DataFrame:
    """K6: best baseline accuracy per dataset."""
    return baseline.groupBy("dataset").agg(F.max("accuracy").alias("best_accuracy"))


def paper_delta(results: DataFrame, paper: DataFrame, group: str = "G6") -> DataFrame:
    """K7: the G6 rows with the paper's accuracy for the same model and the
    delta, ordered by accuracy (descending)."""
    g = results.where(F.col("feature_group") == group).withColumn("_letter", dataset_letter("dataset"))
    p = paper.select(dataset_letter("dataset").alias("_letter"), "model_name",
                     F.col("accuracy").alias("paper_accuracy"), F.col("f1").alias("paper_f1"))
    j = g.join(p, ["_letter", "model_name"], "left").drop("_letter")
    return j.select("dataset", "model_name", "accuracy", "f1", "paper_accuracy", "paper_f1",
                    (F.col("accuracy") - F.col("paper_accuracy")).alias("delta_accuracy")) \
        .orderBy("dataset", F.desc("accuracy"))


def best_per_dataset(results: DataFrame, metrics=("accuracy", "f1", "auc")) -> DataFrame:
    """K7 (tail): best value of each metric per dataset."""
    return results.groupBy("dataset").agg(*[F.max(m).alias("best_" + m) for m in metrics if m in results.columns])


def metric_pivot(results: DataFrame, metric: str = "accuracy", models: list[str] | None = None) -> DataFrame:
    """K8: feature groups x models matrix of the mean metric."""
    g = results.groupBy("feature_group")
    return (g.pivot("model_name", models) if models else g.pivot("model_name")).agg(F.avg(metric))


def group_bars(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """K9: mean metric per (feature group, model)."""
    return results.groupBy("feature_group", "model_name").agg(F.avg(metric).alias(metric))


def accuracy_vs_time(results: DataFrame, time_col: str = "inference_ms_per_1k") -> DataFrame:
    """(model, group, time, accuracy) points."""
    return results.select("dataset", "model_name", "feature_group", time_col, "accuracy") \
        .where(F.col(time_col).isNotNull())


def metric_listing(results: DataFrame, cols=None, digits: int = 4) -> DataFrame:
    """Default metric columns (available only), rounded."""
    cols = cols or ["model_name", "feature_group", "accuracy", "precision", "recall", "f1", "auc",
                    "brier_score", "ece"]
    return M.rounded(results.select(*[c for c in cols if c in results.columns]), digits, settle=12)


def datasets(results: DataFrame) -> DataFrame:
    """Distinct datasets in order."""
    return results.select("dataset").distinct().orderBy("dataset")


def full_report(results: DataFrame, paper: DataFrame, baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report's sections in order, as DataFrames."""
    base = baseline if baseline is not None else results.where(F.col("feature_group") == "G6")
    out = {"paper_baselines": paper, "best_accuracy": best_accuracy(results, paper)}
    if "inference_ms_per_1k" in results.columns:
        out["fastest_within_1pct"] = fastest_within(results)
    out["calibration_extremes"] = calibration_extremes(results)
    out["baseline_table"] = metric_listing(base)
    out["extended_table"] = extended_table(results)
    return out


def results_from_predictions(pred: DataFrame, metrics=M.METRICS) -> DataFrame:
    """H10 -> H12: the results table (mean and std over folds) of a predictions table."""
    fm = M.all_metrics(pred)
    return M.fold_summary(fm, metrics=list(metrics))
