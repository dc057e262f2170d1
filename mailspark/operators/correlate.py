"""2.J: Spearman correlation of features, group summaries, class profile.

Ranks are average ranks (ties share the mean rank).  Rank tables are built from
the columns' distinct values with an exact range-partitioned running count.
Tables that together stay under a counted bound travel to the tasks as sorted
arrays; a column with more distinct values is joined to its table.  Every task
streams its rows into one matrix of moments per pair of columns, and the
correlations are a small aggregate of those.  The group summaries work on the
long-form correlation table (features x features rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.operators.numbering import cumulative_sum_by
from mailspark.session import checkpoint_dir

#: distinct values, of all columns together, up to which rank tables are broadcast
BROADCAST_RANKS = 500_000


def _value(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def rank_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(_col, _val, _cnt, _rank)``: average rank of every distinct value of each
    column, in one pass over the unpivoted values; nulls and NaN have none."""
    long = df.select(*[_value(c).alias(c) for c in columns]).unpivot([], columns, "_col", "_val") \
        .where(F.col("_val").isNotNull())
    d = long.groupBy("_col", "_val").agg(F.count(F.lit(1)).alias("_cnt"))
    d = cumulative_sum_by(d, ["_col"], ["_val"], "_cnt", out="_before")
    return d.select("_col", "_val", "_cnt", (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias("_rank"))


def _moments(columns: list[str], tables, means: dict[str, float]):
    """Arrow step: per task, one row of moments for each pair of columns.  Values
    of the columns in ``tables`` are looked up there, others are ranks already.
    Ranks are taken from their mean, so nothing cancels in the sums."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32())] + [(c, pa.float64()) for c in ("n", "si", "sj", "sii", "sjj", "sij")])

    def run(batches):
        known, total = tables.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = []
            for c in columns:
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                if c in known:
                    values, rank = known[c]
                    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                    x = np.where(np.isnan(x), np.nan, rank[at])
                ranks.append(x - means.get(c, 0.0))
            x = np.column_stack(ranks)
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(columns), 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)],
                                             schema=schema)
    return run


def spearman_pairs(df: DataFrame, columns: list[str], broadcast_ranks: int = BROADCAST_RANKS) -> DataFrame:
    """J1 + J5: long form ``(f1, f2, spearman, distance)`` for every pair f1 < f2
    in column order; undefined correlations (constant columns) are null."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    d = rank_table(df, columns).checkpoint()
    # one row per column
    sizes = {r["_col"]: (r.values_, r.rows_) for r in d.groupBy("_col").agg(
        F.count(F.lit(1)).alias("values_"), F.sum("_cnt").alias("rows_")).collect()}
    known, room = [], broadcast_ranks
    for c in sorted(sizes, key=lambda c: sizes[c][0]):
        room -= sizes[c][0]
        if room < 0:
            break
        known.append(c)
    tables = {}
    if known:
        t = d.where(F.col("_col").isin(known)).select("_col", "_val", "_rank").toPandas().sort_values(["_col", "_val"])
        tables = {c: (g["_val"].to_numpy(), g["_rank"].to_numpy()) for c, g in t.groupby("_col")}
    rows = df.select(*[_value(c).alias(c) for c in columns])
    for c in sizes.keys() - set(known):
        rank = d.where(F.col("_col") == c).select(F.col("_val").alias(c), F.col("_rank").alias("_r"))
        rows = rows.join(rank, c, "left").drop(c).withColumnRenamed("_r", c)
    means = {c: (n + 1) / 2.0 for c, (_, n) in sizes.items()}
    sums = ["n", "si", "sj", "sii", "sjj", "sij"]
    moments = rows.select(*columns).mapInArrow(
        _moments(columns, spark.sparkContext.broadcast(tables), means), "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    t = moments.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    n, si, sj = F.col("n"), F.col("si"), F.col("sj")
    vi, vj = n * F.col("sii") - si * si, n * F.col("sjj") - sj * sj
    # a column that is constant where both are present leaves rounding noise at most
    varies = (vi > 1e-9 * n * F.col("sii")) & (vj > 1e-9 * n * F.col("sjj"))
    r = F.when(varies, (n * F.col("sij") - si * sj) / F.sqrt(vi) / F.sqrt(vj))
    names = F.array(*map(F.lit, columns))
    return t.select(F.get(names, "i").alias("f1"), F.get(names, "j").alias("f2"), r.alias("spearman")) \
        .withColumn("distance", 1.0 - F.abs("spearman")).checkpoint()


def _symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select("f1", "f2", "spearman").unionByName(
        pairs.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "spearman"))


def group_positions(spark: SparkSession, groups: dict[str, list[str]], available: list[str]) -> DataFrame:
    """``(feature_group, gpos, feature, pos, first_group)``: the concatenated
    feature list in group order; a feature's home group is the first listing it."""
    rows, home, pos = [], {}, 0
    for g, feats in groups.items():
        present = [f for f in feats if f in available]
        for i, f in enumerate(present):
            pos += 1
            home.setdefault(f, g)
            rows.append((g, i + 1, f, pos))
    data = [(g, gp, f, p, home[f]) for g, gp, f, p in rows]
    return spark.createDataFrame(data, "feature_group string, gpos int, feature string, pos int, first_group string")


def within_group_corr(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """Per group, mean over columns j of the mean |r_ij| over i < j
    (strict upper triangle), NaN skipped; null for groups under two features."""
    sym = _symmetric(pairs)
    a = positions.select("feature_group", F.col("gpos").alias("i"), F.col("feature").alias("fi"))
    b = positions.select("feature_group", F.col("gpos").alias("j"), F.col("feature").alias("fj"))
    tri = a.join(b, "feature_group").where(F.col("i") < F.col("j"))  # features x features, metadata only
    tri = tri.join(sym, (tri.fi == sym.f1) & (tri.fj == sym.f2), "left")
    col_means = tri.groupBy("feature_group", "j").agg(F.avg(F.abs("spearman")).alias("m"))
    res = col_means.groupBy("feature_group").agg(F.avg("m").alias("within_corr"))
    sizes = positions.groupBy("feature_group").agg(F.count(F.lit(1)).alias("n_features"))
    return sizes.join(res, "feature_group", "left") \
        .withColumn("within_corr", F.when(F.col("n_features") >= 2, F.col("within_corr")))


def between_group_corr(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean |r| over position pairs i < j of the concatenated list whose
    home groups differ (repeated features count repeatedly)."""
    sym = _symmetric(pairs)
    a = positions.select(F.col("pos").alias("i"), F.col("feature").alias("fi"), F.col("first_group").alias("gi"))
    b = positions.select(F.col("pos").alias("j"), F.col("feature").alias("fj"), F.col("first_group").alias("gj"))
    t = a.join(b, (F.col("i") < F.col("j")) & (F.col("gi") != F.col("gj")))
    t = t.join(sym, (t.fi == sym.f1) & (t.fj == sym.f2), "left")
    return t.agg(F.avg(F.abs("spearman")).alias("between_corr"), F.count(F.lit(1)).alias("n_pairs"))


def overall_corr(within: DataFrame, between: DataFrame) -> DataFrame:
    """Mean of the groups' within means (undefined ones skipped) and its
    ratio to the between mean; both tables hold a row per group or one row."""
    w = within.agg(F.avg("within_corr").alias("mean_within"))
    return w.join(between.select("between_corr")).select(
        "mean_within", "between_corr", F.try_divide("mean_within", "between_corr").alias("ratio"))


def class_means(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Mean of each feature per class, one row per feature."""
    m = df.groupBy(label).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = m.unpivot([label], columns, "feature", "mean")
    return long.groupBy("feature").agg(
        F.max(F.when(F.col(label) == 0, F.col("mean"))).alias("mean_ham"),
        F.max(F.when(F.col(label) == 1, F.col("mean"))).alias("mean_spam"))
