"""2.H: classification and calibration metrics over a ``predictions`` table.

Every metric is a group-by keyed by the experiment cell (dataset,
feature_group, model_name, fold), so one job scores the whole matrix.
Partial aggregation happens map-side; rank-based metrics (AUC, AP) first
reduce to distinct scores, then take cumulative counts inside score buckets
plus per-bucket offsets, so no single task has to order a whole cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark.operators.numbering import cumulative_sums_by

CELL = ["dataset", "feature_group", "model_name", "fold"]
METRICS = ["accuracy", "precision", "recall", "f1", "auc", "brier_score", "ece"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (the reference's zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(pred: DataFrame, keys=CELL) -> DataFrame:
    """tp, fp, fn, tn, n per cell."""
    yt, yp = F.col("y_true"), F.col("y_pred")
    return pred.groupBy(*keys).agg(
        F.sum(((yt == 1) & (yp == 1)).cast("long")).alias("tp"),
        F.sum(((yt == 0) & (yp == 1)).cast("long")).alias("fp"),
        F.sum(((yt == 1) & (yp == 0)).cast("long")).alias("fn"),
        F.sum(((yt == 0) & (yp == 0)).cast("long")).alias("tn"),
        F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, keys=CELL) -> DataFrame:
    """H1-H4, H7, H9: accuracy, precision, recall, F1, Brier, mean confidence,
    positive rate (the reference calls it mean accuracy)."""
    yt, yp, pr = F.col("y_true"), F.col("y_pred"), F.col("y_prob")
    agg = pred.groupBy(*keys).agg(
        F.sum(((yt == 1) & (yp == 1)).cast("long")).alias("tp"),
        F.sum(((yt == 0) & (yp == 1)).cast("long")).alias("fp"),
        F.sum(((yt == 1) & (yp == 0)).cast("long")).alias("fn"),
        F.count(F.lit(1)).alias("n"),
        F.avg((yt == yp).cast("double")).alias("accuracy"),
        F.avg(F.pow(pr - yt, 2)).alias("brier_score"),
        F.avg(pr).alias("mean_confidence"),
        F.avg(yt.cast("double")).alias("positive_rate"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(*keys, "n", "accuracy",
                      _ratio(tp, tp + fp).alias("precision"),
                      _ratio(tp, tp + fn).alias("recall"),
                      _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                      "brier_score", "mean_confidence", "positive_rate")


def brier(pred: DataFrame, keys=CELL) -> DataFrame:
    """H7: mean squared difference of probability and label."""
    return pred.groupBy(*keys).agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("brier_score"))


def _score_counts(pred: DataFrame, keys, descending: bool) -> DataFrame:
    """Distinct scores per cell with positive / negative counts and the
    number of rows ranked strictly before each score (ascending or
    descending).  Ranges of scores follow the data, so scores that pile up
    near 0 and 1 are split over tasks."""
    g = pred.groupBy(*keys, "y_prob").agg(
        F.sum(F.col("y_true").cast("long")).alias("pos"),
        F.sum((1 - F.col("y_true")).cast("long")).alias("neg"))
    g = g.withColumn("_rank", -F.col("y_prob") if descending else F.col("y_prob"))
    return cumulative_sums_by(g, list(keys), ["_rank"], {"pos_before": "pos", "neg_before": "neg"}).drop("_rank")


def roc_auc(pred: DataFrame, keys=CELL) -> DataFrame:
    """H5: tie-aware ROC AUC (Mann-Whitney); null when a cell has one class."""
    g = _score_counts(pred, keys, descending=False)
    # average rank of a tie group = rows before + (group size + 1) / 2
    rank = F.col("pos_before") + F.col("neg_before") + (F.col("pos") + F.col("neg") + 1) / 2.0
    agg = g.groupBy(*keys).agg(F.sum(F.col("pos") * rank).alias("rsum"),
                               F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    p, n = F.col("P"), F.col("N")
    return agg.select(*keys, F.when((p > 0) & (n > 0), (F.col("rsum") - p * (p + 1) / 2.0) / (p * n))
                      .alias("auc"))


def average_precision(pred: DataFrame, keys=CELL) -> DataFrame:
    """H6: step-wise average precision over distinct thresholds; null without positives."""
    g = _score_counts(pred, keys, descending=True)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    agg = g.groupBy(*keys).agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("s"), F.sum("pos").alias("P"))
    return agg.select(*keys, F.when(F.col("P") > 0, F.col("s") / F.col("P")).alias("average_precision"))


def bin_edge(k: Column, n_bins: int) -> Column:
    """k-th of n_bins + 1 equal-width edges on [0, 1], computed as
    ``k * (1 / n)`` like an evenly spaced grid (so 0.3 < edge 3), last = 1."""
    return F.when(k >= n_bins, F.lit(1.0)).otherwise(k.cast("double") * (1.0 / n_bins))


def ece_bin(p: Column, n_bins: int) -> Column:
    """Left-closed bin [lo, hi) of p; p outside [0, 1) gets no bin (null)."""
    b0 = F.least(F.greatest(F.floor(p * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    b1 = F.when(p < bin_edge(b0, n_bins), b0 - 1).when(p >= bin_edge(b0 + 1, n_bins), b0 + 1).otherwise(b0)
    return F.when((p >= 0) & (p < 1.0) & (b1 >= 0) & (b1 < n_bins), b1)


def reliability_bin(p: Column, n_bins: int) -> Column:
    """Right-closed bin (lo, hi] of p, 0 in the first and 1 in the last bin."""
    b0 = F.least(F.greatest(F.ceil(p * n_bins) - 1, F.lit(0)), F.lit(n_bins - 1)).cast("int")
    return (F.when((b0 > 0) & (p <= bin_edge(b0, n_bins)), b0 - 1)
            .when((b0 < n_bins - 1) & (p > bin_edge(b0 + 1, n_bins)), b0 + 1).otherwise(b0))


def ece(pred: DataFrame, keys=CELL, n_bins: int = 10) -> DataFrame:
    """H8: expected calibration error, sum over bins of cnt/n * |conf - acc|,
    computed as (1/n) * sum |sum(p) - sum(y)|; p = 1.0 falls in no bin but
    counts in n."""
    p = pred.withColumn("bin", ece_bin(F.col("y_prob"), n_bins))
    per_bin = p.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"),
                                          F.sum("y_true").alias("sy"), F.sum("y_prob").alias("sp"))
    return per_bin.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy")))), F.lit(0.0))
         / F.sum("cnt")).alias("ece"))


def reliability_curve(pred: DataFrame, keys=CELL, n_bins: int = 10) -> DataFrame:
    """Fraction of positives and mean score per non-empty uniform bin."""
    p = pred.withColumn("bin", reliability_bin(F.col("y_prob"), n_bins))
    return p.groupBy(*keys, "bin").agg(F.avg(F.col("y_true").cast("double")).alias("fraction_of_positives"),
                                       F.avg("y_prob").alias("mean_predicted"),
                                       F.count(F.lit(1)).alias("n"),
                                       F.sum(F.col("y_true").cast("long")).alias("n_positive"),
                                       F.sum("y_prob").alias("sum_predicted"))


def score_histogram(pred: DataFrame, by: str = "y_true", n_bins: int = 30) -> DataFrame:
    """Equal-width histogram of scores per class (edges from the class's
    min and max, last bin closed); the per-class range is a tiny aggregate."""
    rng = pred.groupBy(by).agg(F.min("y_prob").alias("lo"), F.max("y_prob").alias("hi"))
    lo = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("hi") == F.col("lo"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    rng = rng.select(by, lo.alias("lo"), hi.alias("hi"))
    j = pred.select(by, "y_prob").join(F.broadcast(rng), by)
    step = (F.col("hi") - F.col("lo")) / n_bins

    def edge(k: Column) -> Column:
        return F.when(k >= n_bins, F.col("hi")).otherwise(k * step + F.col("lo"))
    b0 = ((F.col("y_prob") - F.col("lo")) * (n_bins / (F.col("hi") - F.col("lo")))).cast("int")
    b0 = F.when(b0 == n_bins, n_bins - 1).otherwise(b0)
    b1 = F.when(F.col("y_prob") < edge(b0), b0 - 1) \
        .when((F.col("y_prob") >= edge(b0 + 1)) & (b0 != n_bins - 1), b0 + 1).otherwise(b0)
    return j.withColumn("bin", b1).groupBy(by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first(edge(F.col("bin"))).alias("bin_lo"))


def all_metrics(pred: DataFrame, keys=CELL, n_bins: int = 10, prefix: str = "") -> DataFrame:
    """The fold metric set joined on the cell key; optional prefix."""
    m = classification_metrics(pred, keys).join(roc_auc(pred, keys), keys) \
        .join(average_precision(pred, keys), keys).join(ece(pred, keys, n_bins), keys)
    if prefix:
        m = m.withColumnsRenamed({c: prefix + c for c in m.columns if c not in keys})
    return m


def fold_summary(fold_metrics: DataFrame, metrics=METRICS,
                 by=("dataset", "feature_group", "model_name")) -> DataFrame:
    """Mean and population std over folds, NaN ignored, plus n_folds."""
    aggs = []
    for m in metrics:
        v = F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(v).alias(m), F.stddev_pop(v).alias(m + "_std")]
    return fold_metrics.groupBy(*by).agg(*aggs, F.countDistinct("fold").alias("n_folds"))


def timing_stats(timings: DataFrame, value: str = "seconds", by=()) -> DataFrame:
    """Mean, population std, min and max of recorded times."""
    return timings.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))


def confidence_rows(pred: DataFrame) -> DataFrame:
    """Per-mail confidence table with a ``correct`` flag."""
    return pred.select(F.col("mail_id").alias("email_idx"), "y_true", "y_pred",
                       F.col("y_prob").alias("confidence"),
                       (F.col("y_true") == F.col("y_pred")).cast("int").alias("correct"),
                       F.col("model_name").alias("model"), "feature_group")


def round_half_away(x: Column, digits: int = 6) -> Column:
    """Round a DOUBLE on its binary value, half away from zero (C's ``round``
    of ``x * 10^d``), so results agree with engines that round that way."""
    m = float(10 ** digits)
    r = F.signum(x) * F.floor(F.abs(x) * m + 0.5).cast("double") / m
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 1e12), x).otherwise(r)


def rounded(df: DataFrame, digits: int = 6, settle: int | None = None) -> DataFrame:
    """Round every DOUBLE column (for value-hash comparisons).  ``settle``
    rounds to that many digits first, so that means whose sums ran in another
    order do not part on a rounding tie."""
    def shown(c: Column) -> Column:
        return round_half_away(c if settle is None else round_half_away(c, settle), digits)
    return df.select(*[shown(F.col(f.name)).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


RESULT_SCHEMA = ("dataset string, model_name string, feature_group string, n_features int, accuracy double, "
                 "precision double, recall double, f1 double, auc double, brier_score double, ece double, "
                 "train_time_s double, inference_ms_per_1k double")


def metrics_to_frame(spark, rows: list[dict]) -> DataFrame:
    """Metric rows (dicts) -> results table with a fixed schema; missing keys are null."""
    names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RESULT_SCHEMA)
