"""2.I: feature importance and selection.

Permutation importance shuffles by a keyed bijection of the row number
(``permute``): the row at place i gets the features of the row that the
bijection of a repeat sends there, the same for all features of a repeat.
One join a repeat puts all shuffled features beside the rows, so what moves
is linear in rows and repeats; the features are then scored one by one, and
a feature's repeats are made where the row is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.operators import permute
from mailspark.operators.folds import holdout_split, stratified_folds
from mailspark.operators.models import fit_pipeline, in_parallel
from mailspark.operators.numbering import row_number_by

#: what a round of RFECV leaves behind
_ROUND = "n_features int, cv_f1_weighted double, features string, importances array<double>"


def permuted_rows(rows: DataFrame, cols: list[str], n_repeats: int = 3, seed: int = 42, id_col: str = "mail_id") -> DataFrame:
    """``id_col``, ``label``, ``cols`` and ``_x0``, ``_x1``, ...: the features of the row
    that repeat 0, 1, ... puts in this row's place.  Rows are numbered by id."""
    base = rows.select(id_col, "label", *[F.col(c).cast("double").alias(c) for c in cols])
    idx = row_number_by(base, [], [id_col], out="_i").withColumn("_i", F.col("_i") - 1).checkpoint()
    n = idx.count()
    out = idx
    for r in range(n_repeats):
        out = out.join(idx.select(permute.shuffled(F.col("_i"), n, permute.keys(seed, r)).alias("_i"),
                                  F.array(*cols).alias(f"_x{r}")), "_i")
    return out.drop("_i")


def permutation_importance(model: PipelineModel | Callable[[DataFrame], DataFrame], test: DataFrame, cols: list[str],
                           n_repeats: int = 3, seed: int = 42, id_col: str = "mail_id") -> DataFrame:
    """Mean and population std over repeats of the accuracy drop when one
    feature is permuted among the test rows; sorted by mean, descending.
    ``model`` is a fitted pipeline, or adds ``prediction`` to rows itself."""
    score = model if callable(model) else model.transform
    rows = permuted_rows(test, cols, n_repeats, seed, id_col).checkpoint()
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))

    def drops(c: str) -> list[tuple]:
        others = [o for o in cols if o != c]
        repeats = F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"_x{r}")[cols.index(c)].alias("v")) for r in range(n_repeats)])
        variants = rows.select("label", *others, F.explode(repeats).alias("_e")).select(
            "label", *others, F.col("_e.v").alias(c), F.col("_e.rep").alias("rep"))
        return [(c, r.acc) for r in score(variants).groupBy("rep").agg(right.alias("acc")).collect()]

    first, *rest = in_parallel([lambda: score(rows).agg(right).first()[0], *[lambda c=c: drops(c) for c in cols]])
    # a row per feature and repeat
    acc = test.sparkSession.createDataFrame([d for part in rest for d in part], "feature string, acc double")
    drop = acc.withColumn("drop", F.lit(first) - F.col("acc"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                       F.stddev_pop("drop").alias("importance_std")) \
        .orderBy(F.desc("importance_mean"), "feature")


def dataset_importance(df: DataFrame, cols: list[str], dataset: str = "A", n_repeats: int = 3,
                       seed: int = 42) -> DataFrame:
    """RF on all columns, 20 % stratified hold-out, permutation importance."""
    split = holdout_split(df.select("mail_id", "label", *cols), 0.2, seed).checkpoint()  # read by every pass of the fit
    model = fit_pipeline(split.where("is_test = 0"), cols, num_trees=100, max_depth=30, min_instances=1, seed=seed)
    imp = permutation_importance(model, split.where("is_test = 1"), cols, n_repeats, seed)
    return imp.select(F.lit(dataset).alias("dataset"), "*")


def mdi_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Impurity importance and its std across the forest's trees."""
    assembler = [s for s in model.stages if isinstance(s, VectorAssembler)][0]
    rf = model.stages[-1]
    cols = list(assembler.getInputCols())
    per_tree = np.array([t.featureImportances.toArray() for t in rf.trees])
    mean = rf.featureImportances.toArray()
    std = per_tree.std(axis=0)
    rows = [(c, float(mean[i]), float(std[i])) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, importance_mean double, importance_std double") \
        .orderBy(F.desc("importance_mean"), "feature")


def rfecv(df: DataFrame, cols: list[str], k: int = 5, step: int = 1, min_features: int = 1,
          num_trees: int = 50, seed: int = 42, ledger: str | None = None) -> tuple[list[str], DataFrame]:
    """I4: recursive elimination with CV; each round drops the ``step``
    weakest features (impurity importance of a fit on all rows) and records
    the CV mean weighted F1; returns the best subset and the score table.

    The fits of a round (its folds and the one on all rows) run side by side.  With a ``ledger`` folder every
    round is written there and a later call with the same settings goes on after the last one."""
    spark = df.sparkSession
    settings = hashlib.sha256(json.dumps([list(cols), k, step, min_features, num_trees, seed]).encode()).hexdigest()[:16]
    book = f"{ledger.rstrip('/')}/{settings}" if ledger else None
    # a row per round
    rounds = [(r.n_features, r.cv_f1_weighted, r.features, list(r.importances)) for r in
              spark.read.schema(_ROUND).parquet(f"{book}/*").orderBy(F.desc("n_features")).collect()] \
        if book and _exists(spark, book) else []
    folded = stratified_folds(df, k=k, seed=seed).cache()
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="weightedFMeasure")

    def fold_score(f: int, current: list[str]) -> float:
        m = fit_pipeline(folded.where(F.col("fold") != f), current, num_trees, 30, 1, seed, True)
        return ev.evaluate(m.transform(folded.where(F.col("fold") == f).withColumns({c: F.col(c).cast("double") for c in current})))

    current = survivors(rounds[-1][2].split(","), rounds[-1][3], step, min_features) if rounds else list(cols)
    try:
        while not rounds or len(rounds[-1][2].split(",")) > min_features:
            jobs = [lambda f=f: fold_score(f, current) for f in range(k)]
            full, *fs = in_parallel([lambda: fit_pipeline(folded, current, num_trees, 30, 1, seed, True), *jobs])
            rounds.append((len(current), float(np.mean(fs)), ",".join(current), [float(x) for x in full.stages[-1].featureImportances.toArray()]))
            if book:
                spark.createDataFrame(rounds[-1:], _ROUND).coalesce(1).write.mode("overwrite").parquet(f"{book}/round-{len(current):05d}")
            current = survivors(current, rounds[-1][3], step, min_features)
    finally:
        folded.unpersist()
    table = spark.createDataFrame([r[:3] for r in rounds], "n_features int, cv_f1_weighted double, features string")
    best = max(rounds, key=lambda s: (s[1], -s[0]))
    return best[2].split(","), table


def survivors(current: list[str], importances: list[float], step: int, min_features: int) -> list[str]:
    """The features left when the ``step`` weakest go (the name breaks ties), but never fewer than ``min_features``."""
    order = sorted(range(len(current)), key=lambda i: (importances[i], current[i]))
    drop = {current[i] for i in order[:max(0, min(step, len(current) - min_features))]}
    return [c for c in current if c not in drop]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def importance_to_dict(importance: DataFrame, col: str = "importance_mean") -> dict[str, float]:
    """Small lookup (one row per feature)."""
    return {r["feature"]: r[col] for r in importance.select("feature", col).collect()}


def top_n(importance: DataFrame, n: int = 10, col: str = "importance_mean") -> DataFrame:
    """The n most important features (name breaks ties)."""
    return importance.orderBy(F.desc(col), "feature").limit(n)

