"""2.E: cleaning of a labelled feature table (the dataset builder).

Medians and 99th percentiles are exact: distinct values with their counts
are numbered in value order over range partitions, so no task holds the
values of a whole column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from mailspark.operators.numbering import cumulative_sum_by, row_number_by

# --- fixed values: name fragments the reference treats as "count" columns --
COUNT_MARKERS = ["count", "n_", "len", "hops", "hop"]
AUTH_MARKERS = ["spf", "dkim", "dmarc", "auth"]
# ---------------------------------------------------------------------------


def drop_metadata(df: DataFrame) -> DataFrame:
    """Drop columns whose name starts with '_'."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def split_types(df: DataFrame, exclude=("label", "mail_id")) -> tuple[list[str], list[str]]:
    """(numeric columns, string columns)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]
    return num, cat


def label_encode(df: DataFrame, columns: list[str], null_text: str | None = "nan") -> DataFrame:
    """Replace each string column by the 0-based rank of its value among
    the sorted distinct values.  A null counts as the text ``null_text``
    (None: it stays null)."""
    out = df if null_text is None else df.fillna(null_text, subset=columns) if columns else df
    for c in columns:
        # dense rank = row number over the distinct values (range-partitioned,
        # so even a high-cardinality column never sorts in one task)
        distinct = out.select(c).where(F.col(c).isNotNull()).distinct()
        codes = row_number_by(distinct, [], [c], out="_rn").select(c, (F.col("_rn") - 1).cast("int").alias("_code"))
        out = out.join(codes, c, "left").drop(c).withColumnRenamed("_code", c)
    return out.select(*df.columns)


def quantiles(df: DataFrame, columns: list[str], q: float) -> dict[str, float | None]:
    """Exact quantiles (linear interpolation, nulls skipped) of all columns."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]) \
        .unpivot([], [f"c{i}" for i in range(len(columns))], "_col", "_val").where(F.col("_val").isNotNull())
    d = long.groupBy("_col", "_val").agg(F.count(F.lit(1)).alias("_cnt"))
    d = cumulative_sum_by(d, ["_col"], ["_val"], "_cnt", out="_before")
    total = d.groupBy("_col").agg(F.sum("_cnt").alias("_n"))  # a row per column
    d = d.join(F.broadcast(total), "_col")
    at = F.lit(q) * (F.col("_n") - 1)

    def value(index):
        return F.max(F.when((F.col("_before") <= index) & (index < F.col("_before") + F.col("_cnt")), F.col("_val")))
    rows = d.groupBy("_col").agg(value(F.floor(at)).alias("lo"), value(F.ceil(at)).alias("hi"),
                                 F.max(at - F.floor(at)).alias("part")).collect()
    found = {r["_col"]: r["lo"] if r["lo"] == r["hi"] else r["lo"] + (r["hi"] - r["lo"]) * r["part"] for r in rows}
    return {c: found.get(f"c{i}") for i, c in enumerate(columns)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of all columns."""
    return quantiles(df, columns, 0.5)


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """E5: fill nulls with the column median; imputed columns become DOUBLE."""
    cols = columns if columns is not None else split_types(df)[0]
    med = medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double"))
                           for c in cols})


def count_columns(columns: list[str], mode: str = "reference") -> list[str]:
    """Columns to clip.  ``reference`` = name contains a count marker
    (this also picks some 0/1 flags); ``counts`` = the same minus flags."""
    picked = [c for c in columns if any(m in c for m in COUNT_MARKERS)]
    if mode == "counts":
        picked = [c for c in picked if not (c.startswith("has_") or c.startswith("is_")
                                            or "_eq_" in c or c.endswith("_differs") or "mismatch" in c
                                            or c.endswith("_non_ascii") or c.startswith("excessive")
                                            or "_subdomain_" in c)]
    return picked


def p99_caps(df: DataFrame, columns: list[str], q: float = 0.99) -> dict[str, float | None]:
    return quantiles(df, columns, q)


def clip_p99(df: DataFrame, columns: list[str] | None = None, mode: str = "reference",
             q: float = 0.99) -> DataFrame:
    """Cap the chosen columns at their 99th percentile (upper side only)."""
    cols = columns if columns is not None else count_columns(split_types(df)[0], mode)
    caps = p99_caps(df, cols, q)
    return df.withColumns({c: F.least(F.col(c).cast("double"), F.lit(caps[c]).cast("double"))
                           for c in cols if caps[c] is not None})


def constant_columns(df: DataFrame, keep=("label",)) -> list[str]:
    """Columns with at most one distinct non-null value (min = max or all null)."""
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return []
    row = df.agg(*[x for c in cols for x in (F.min(c).alias("mn_" + c), F.max(c).alias("mx_" + c))]).first()
    return [c for c in cols if row["mn_" + c] is None or row["mn_" + c] == row["mx_" + c]]


def drop_constant(df: DataFrame, keep=("label",)) -> tuple[DataFrame, list[str]]:
    """Drop constant columns (never the label, trap T4); returns the list too."""
    const = constant_columns(df, keep)
    return df.drop(*const), const


def zero_fill_auth(df: DataFrame) -> DataFrame:
    """Nulls in authentication columns become 0."""
    cols = [c for c in df.columns if any(m in c for m in AUTH_MARKERS)]
    return df.fillna(0, subset=cols) if cols else df


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def clean_and_encode(df: DataFrame, dataset: str = "A", clip_mode: str = "reference"
                     ) -> tuple[DataFrame, list[str]]:
    """E2-E9 in the reference's order; returns the table and dropped columns."""
    df = drop_metadata(df)
    num, cat = split_types(df)
    df = label_encode(df, cat)
    df = impute_median(df, num)
    df = clip_p99(df, count_columns(num, clip_mode))
    df, dropped = drop_constant(df)
    if dataset.upper().endswith("B"):
        df = zero_fill_auth(df)
    return df, dropped
