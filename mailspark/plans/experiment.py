"""G17m/G18m: the experiment matrix datasets x feature groups x models.

Each cell is a cross-validated fit (G14m); all cells write into one
predictions table, scored by one metrics job (2.H) into ``results``.  A
failing cell is recorded in ``failures`` and skipped, like the reference.
"""

from __future__ import annotations

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.operators import groups as G
from mailspark.operators import metrics as M
from mailspark.operators import models as MD
from mailspark.operators.folds import stratified_folds


_LOG = ("dataset string, feature_group string, model_name string, settings string, status string, error string, "
        "n_features int, train_s double, score_s double, n_test long")
_CELL = ["dataset", "feature_group", "model_name"]


class Ledger:
    """Finished and failed cells in a shared folder: the predictions of each
    cell and a log row that is written after them, so a cell counts as finished
    only when its predictions are whole.  A cell is known by its names and a hash of
    its settings (columns, folds, seed, parameters)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        # a row per cell
        rows = spark.read.schema(_LOG).parquet(f"{self.path}/log/*").collect() if known else []
        self.done = {(r.dataset, r.feature_group, r.model_name, r.settings): r for r in rows if r.status == "done"}

    def _place(self, kind: str, cell: tuple) -> str:
        return f"{self.path}/{kind}/" + "-".join(re.sub(r"[^A-Za-z0-9_]", "_", str(c)) for c in cell[:3])

    def predictions(self, cell: tuple) -> DataFrame:
        return self.spark.read.parquet(self._place("cells", cell))

    def write(self, cell: tuple, settings: str, pred: DataFrame | None, error: str | None, n_features: int, times: list[tuple]) -> None:
        if pred is not None:
            pred.write.mode("overwrite").parquet(self._place("cells", cell))
        row = (*cell, settings, "done" if error is None else "failed", error, n_features,
               sum((t[4] for t in times), 0.0) / max(1, len(times)), sum((t[5] for t in times), 0.0), sum(t[6] for t in times))
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("overwrite").parquet(self._place("log", cell))


def run_matrix(spark: SparkSession, tables: dict[str, DataFrame], groups=("G6",), models=("RF",),
               k: int = 5, seed: int = 42, importance: DataFrame | None = None,
               params: dict | None = None, parallel_cells: int = 1, ledger: str | None = None) -> dict[str, DataFrame]:
    """Returns ``predictions``, ``results`` (fold means / stds + timings) and ``failures``.

    ``parallel_cells`` > 1 submits cells from a thread pool: each cell is a
    chain of small Spark jobs, and concurrent jobs keep the executors busy
    (results do not depend on it; per-fold times then overlap).  With a ``ledger``
    folder finished cells are written there and read back by a later run, which
    runs the missing and the failed ones only."""
    book = Ledger(spark, ledger) if ledger else None
    preds, times, failures, cells, cached = [], [], [], [], []
    for ds, table in tables.items():
        folded = stratified_folds(table, k=k, seed=seed).cache()
        cached.append(folded)
        for g in groups:
            cols = G.group_columns(g, [c for c in table.columns if c not in ("mail_id", "label")], importance)
            if cols:
                cells.extend((ds, folded, g, cols, m) for m in models)

    def run(job):
        ds, folded, g, cols, m = job
        cell, own = (ds, g, m), (params or {}).get(m)
        settings = hashlib.sha256(json.dumps([cols, k, seed, own], sort_keys=True).encode()).hexdigest()
        if book and (found := book.done.get((*cell, settings))):
            return book.predictions(cell), None, (*cell, found.train_s, found.score_s, found.n_test)
        timings: list[tuple] = []
        try:
            p = MD.cv_predictions(folded, cols, m, ds, g, k, own, seed, timings).withColumn("n_features", F.lit(len(cols)))
            if book:
                book.write(cell, settings, p, None, len(cols), timings)
            mean = sum((t[4] for t in timings), 0.0) / max(1, len(timings))
            return p, None, (*cell, mean, sum((t[5] for t in timings), 0.0), sum(t[6] for t in timings))
        except Exception as e:  # noqa: BLE001 - a failed cell is logged and skipped
            if book:
                book.write(cell, settings, None, repr(e), len(cols), timings)
            return None, (*cell, repr(e)), None

    with ThreadPoolExecutor(max_workers=max(1, parallel_cells)) as pool:
        for p, fail, time in pool.map(run, cells):
            if fail is None:
                preds.append(p)
                times.append(time)
            else:
                failures.append(fail)
    for folded in cached:  # the predictions are written down
        folded.unpersist()
    if not preds:
        raise RuntimeError(f"every cell failed; first: {failures[0] if failures else None}")
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    fm = M.all_metrics(pred.drop("n_features"))
    res = M.fold_summary(fm).join(pred.select(*_CELL, "n_features").distinct(), _CELL)
    tm = spark.createDataFrame(times, "dataset string, feature_group string, model_name string, train_time_s double, "
                                      "score_s double, n_test long")
    tm = tm.withColumn("inference_ms_per_row", F.col("score_s") / F.col("n_test") * 1000.0).drop("score_s", "n_test")
    res = res.join(tm, _CELL, "left").withColumn("inference_ms_per_1k", F.col("inference_ms_per_row"))
    fail = spark.createDataFrame(failures, "dataset string, feature_group string, model_name string, error string")
    return {"predictions": pred, "results": res, "failures": fail}


def baseline(results: DataFrame, group: str = "G6") -> DataFrame:
    """G18m: the baseline run is the G6 slice of the matrix (no second run)."""
    return results.where(F.col("feature_group") == group)
