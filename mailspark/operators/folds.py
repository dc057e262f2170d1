"""G1m-G3m, G12m: stratified folds, hold-out split, train-only scaling.

Fold membership is a pure function of (label, id, seed): rows are ordered
per label by ``md5(id || seed)`` (id breaks ties) and dealt round-robin, so
every class is spread evenly and reruns or retried tasks give the same
folds.  Numbering uses range partitioning, not a one-task window, and moves
labels and ids only; the rows meet their number by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mailspark.operators.numbering import row_number_by


def _shuffle_key(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def _numbered(df: DataFrame, label: str, id_col: str, key) -> DataFrame:
    """``_of_label``, ``_of_id`` and their number ``_rn`` within the label: of the
    other columns none is shuffled or written."""
    keys = df.select(F.col(label).alias("_of_label"), F.col(id_col).alias("_of_id"), key.alias("_key")).distinct()
    return row_number_by(keys, ["_of_label"], ["_key", "_of_id"], out="_rn").drop("_key")


def _beside(df: DataFrame, dealt: DataFrame, label: str, id_col: str) -> DataFrame:
    """The rows of ``df`` with what their label and id were dealt (in place of an older
    column of that name); a null id meets the null id."""
    df = df.drop(*[c for c in dealt.columns if c not in ("_of_label", "_of_id")])
    same = (F.col(label) == F.col("_of_label")) & F.col(id_col).eqNullSafe(F.col("_of_id"))
    return df.join(dealt, same, "left").drop("_of_label", "_of_id")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "mail_id",
                     label: str = "label", salt: str = "") -> DataFrame:
    """G1m: append ``fold`` in [0, k).  Rows of one label and id (copies, or
    rows without an id) share a fold; a row without a label has none.  ``df`` is
    read again for the join, so callers that train on it write or cache it."""
    key = _shuffle_key(id_col, seed)
    r = _numbered(df, label, id_col, F.md5(F.concat(key, F.lit(salt))) if salt else key)
    return _beside(df, r.select("_of_label", "_of_id", ((F.col("_rn") - 1) % k).cast("int").alias("fold")), label, id_col)


def holdout_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "mail_id",
                  label: str = "label") -> DataFrame:
    """G2m: append ``is_test``: the first ceil(test_size * n_label) ids of
    each class in shuffle order.  Copies and nulls as in :func:`stratified_folds`."""
    r = _numbered(df, label, id_col, _shuffle_key(id_col, seed))
    # a row per class
    counts = r.groupBy("_of_label").agg(F.max("_rn").alias("_n"))
    r = r.join(counts, "_of_label").select("_of_label", "_of_id", (F.col("_rn") <= F.ceil(F.col("_n") * test_size)).cast("int").alias("is_test"))
    return _beside(df, r, label, id_col)


def fold_stats(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Per held-out fold k: mean and population std of each column over the
    training rows (fold != k), from one aggregate per fold.  Squares are taken
    from the means, so nothing cancels; nulls are left out."""
    value = {c: F.col(c).cast("double") for c in columns}
    per = df.groupBy(fold).agg(*[F.struct(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")).alias("p_" + c) for c, v in value.items()])
    # the k rows of all folds beside each of them
    every = F.collect_list(F.struct(fold, *["p_" + c for c in columns])).over(Window.partitionBy())
    j = per.withColumn("_all", every)
    others = F.filter("_all", lambda r: (r[fold] != F.col(fold)))
    none = F.lit(0).cast("bigint")

    def stats(c: str) -> list:
        parts = F.filter(F.transform(others, lambda r: r["p_" + c]), lambda p: p["n"] > 0)
        n = F.nullif(F.aggregate(parts, none, lambda a, p: a + p["n"]), none)
        mean = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["mean"] * p["n"]) / n
        m2 = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
        return [mean.alias("mean_" + c), F.sqrt(m2 / n).alias("std_" + c)]
    return j.select(fold, *[s for c in columns for s in stats(c)])


def standard_scale(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """G3m: scale each row with the statistics of the training part of its
    fold (population std; zero std -> 1)."""
    st = fold_stats(df, columns, fold)
    j = df.join(F.broadcast(st), fold)  # k rows
    scaled = {}
    for c in columns:
        sd = F.col("std_" + c)
        scaled[c] = (F.col(c).cast("double") - F.col("mean_" + c)) / F.when(sd == 0, 1.0).otherwise(sd)
    return j.withColumns(scaled).drop(*[p + c for c in columns for p in ("mean_", "std_")])


def ham_only(df: DataFrame, label: str = "label") -> DataFrame:
    """G12m: training rows of the one-class model."""
    return df.where(F.col(label) == 0)
