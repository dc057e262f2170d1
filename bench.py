"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and then fully executed into the ``noop`` sink (every
row and column is computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["wide_features", "compact_features", "flagship_class_profile", "classification_metrics",
            "roc_auc", "ece", "stratified_folds", "standard_scale", "spearman_pairs", "extended_table",
            "best_accuracy", "class_cap", "spearman_wide", "clean_wide", "folder_documents", "knn_predict"]
#: one fold (fit and scoring) per model at the size of the published runs, 1200 training and 300 test rows
FOLD_MODELS = ["RF", "SVM", "MLP", "KNN", "OC_SVM"]


def fold_seconds(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of one cross-validation fold per model over the derived feature matrix."""
    from mailspark.operators import clean, folds, models
    from mailspark.plans.queries import _MODEL_COLS
    from mailspark.sources.fixtures import feature_matrix
    table = folds.stratified_folds(clean.impute_median(feature_matrix(spark, sf_dir), _MODEL_COLS), k=5).checkpoint()
    train, test = table.where("fold <> 0"), table.where("fold = 0")
    out = {}
    for m in FOLD_MODELS:
        t = time.perf_counter()
        models.fit_predict(m, train, test, _MODEL_COLS).select("y_pred", "y_prob").write.mode("overwrite").format("noop").save()
        out[f"fold_{m.lower()}"] = round(time.perf_counter() - t, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from mailspark import get_spark
    from mailspark import catalog
    spark = get_spark(f"local[{cpus}]", app="mailspark-bench")
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up (JVM start, JIT of the extractor expressions) on the smallest
    # table set, so that the timings below are steady-state throughput
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("label_counts", "flagship_class_profile", "compact_features"):
        qs[w](spark, warm_dir).write.mode("overwrite").format("noop").save()
    times = {}
    for n in names:
        t = time.perf_counter()
        qs[n](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[n] = round(time.perf_counter() - t, 3)
    times |= fold_seconds(spark, warm_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
