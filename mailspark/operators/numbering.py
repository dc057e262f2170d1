"""Exact per-group row numbers without a one-task window.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends a whole group
to one task; with two labels that is half the data per task.  Here the rows
are range-partitioned on (g, o), numbered locally, and shifted by the counts
of the preceding partitions (a table of n_partitions x n_groups rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark.session import checkpoint_dir

#: offset rows (partitions x groups) up to which they are broadcast
BROADCAST_OFFSETS = 200_000


def _partitions(df: DataFrame, wanted: int | None) -> int:
    """As many range partitions as a shuffle of this session has, so that a
    cluster sized for its data keeps their size bounded."""
    spark = df.sparkSession
    return wanted or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def _with_offsets(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Adds each (partition, group)'s offsets; broadcast only where they are few."""
    few = offsets.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS
    return rows.join(F.broadcast(offsets) if few else offsets, ["_pid", *by])


def row_number_by(df: DataFrame, by: list[str], order: list[Column | str], out: str = "rn",
                  num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = 1-based row number within ``by`` ordered by ``order``
    (``order`` must break ties for a deterministic result).

    Rows are range-partitioned on (by, order); each range partition is
    numbered with a window over (partition, group) and shifted by the row
    counts of the preceding partitions of the same group.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = _partitions(df, num_partitions)
    tmp = [f"_o{i}" for i in range(len(order_cols))]
    r = df.withColumns({t: c for t, c in zip(tmp, order_cols)})
    r = r.repartitionByRange(n, *[F.col(b) for b in by], *[F.col(t) for t in tmp]) \
         .withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *by).orderBy(*[F.col(t) for t in tmp])
    # Range bounds come from sampling and may differ if the plan is recomputed,
    # so the numbered rows are written once (reliable checkpoint in the
    # shared spark.checkpoint.dir) before offsets are derived from them.
    checkpoint_dir(df.sparkSession)
    r = r.withColumn("_loc", F.row_number().over(local)).checkpoint(eager=True)
    # per (partition, group) counts -> offsets: n_partitions x n_groups rows
    stats = r.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    r = _with_offsets(r, stats, by)
    r = r.withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
    return r.drop("_pid", "_loc", "_off", *tmp)


def cumulative_sums_by(df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, str],
                       num_partitions: int | None = None) -> DataFrame:
    """Append, for each ``out: value`` of ``values``, the sum of ``value`` over
    the rows of the same ``by`` group that come strictly before this row in
    ``order`` (ties must be broken by ``order``).  Same scheme as
    :func:`row_number_by`: range partitions, a running sum inside each
    (partition, group), offsets from the per-partition totals; no task ever
    holds a whole group."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = _partitions(df, num_partitions)
    tmp = [f"_o{i}" for i in range(len(order_cols))]
    r = df.withColumns({t: c for t, c in zip(tmp, order_cols)})
    r = r.repartitionByRange(n, *[F.col(b) for b in by], *[F.col(t) for t in tmp]) \
         .withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *by).orderBy(*[F.col(t) for t in tmp]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    checkpoint_dir(df.sparkSession)
    r = r.withColumns({f"_in{i}": F.coalesce(F.sum(v).over(local), F.lit(0)) for i, v in enumerate(values.values())}) \
         .checkpoint(eager=True)
    stats = r.groupBy("_pid", *by).agg(*[F.sum(v).alias(f"_tot{i}") for i, v in enumerate(values.values())])
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    k = range(len(values))
    stats = stats.withColumns({f"_off{i}": F.coalesce(F.sum(f"_tot{i}").over(w), F.lit(0)) for i in k}) \
                 .drop(*[f"_tot{i}" for i in k])
    r = _with_offsets(r, stats, by)
    return r.withColumns({o: F.col(f"_off{i}") + F.col(f"_in{i}") for i, o in enumerate(values)}) \
            .drop("_pid", *[f"_in{i}" for i in k], *[f"_off{i}" for i in k], *tmp)


def cumulative_sum_by(df: DataFrame, by: list[str], order: list[Column | str], value: str,
                      out: str = "cum_before", num_partitions: int | None = None) -> DataFrame:
    """:func:`cumulative_sums_by` of one column."""
    return cumulative_sums_by(df, by, order, {out: value}, num_partitions)
