"""Feature JSON documents and CSV tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from mailspark.operators.compact import COMPACT_FEATURES

DOC_SCHEMA = T.StructType([
    T.StructField("email_id", T.StringType()),
    T.StructField("headers", T.StructType([T.StructField("date", T.StringType()),
                                           T.StructField("message_id", T.StringType())])),
    T.StructField("header_features", T.StructType([T.StructField(c, T.IntegerType()) for c in COMPACT_FEATURES])),
    T.StructField("body_text", T.StringType()),
    T.StructField("attachments", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])


def read_documents(spark: SparkSession, path: str, multiline: bool = True, corrupt: str | None = None) -> DataFrame:
    """Feature documents (one JSON object per file, or JSON lines with
    ``multiline=False``) with the explicit schema; unknown fields are dropped
    and the source file name is kept.  With ``corrupt``, a column of that name holds the
    text of records that are no such document (null for the others),
    ``source_path`` the whole path, and folders below ``path`` are read as well.  A file without bytes has no row."""
    schema = DOC_SCHEMA
    r = spark.read
    if corrupt:
        schema = T.StructType([*DOC_SCHEMA, T.StructField(corrupt, T.StringType())])
        r = r.option("columnNameOfCorruptRecord", corrupt).option("recursiveFileLookup", True)
    df = r.schema(schema).option("multiLine", multiline).json(path) \
        .withColumn("source_file", F.col("_metadata.file_name"))
    return df.withColumn("source_path", F.col("_metadata.file_path")) if corrupt else df


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A10: a labelled feature table exported as CSV (header row).  With no
    schema, every column except ``label`` is read as DOUBLE (one header read,
    no inference pass); a table without ``label`` is an error."""
    if schema is None:
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.IntegerType() if c == "label" else T.DoubleType())
                               for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    if "label" not in df.columns:
        raise ValueError("'label' column not found in feature table")
    return df


def read_results_csv(spark: SparkSession, path: str, baseline_path: str | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Results table and baseline; without a baseline file the baseline
    is the G6 slice of the results."""
    res = spark.read.option("header", True).option("inferSchema", False).csv(path)
    num = [c for c in res.columns if c not in ("dataset", "model_name", "feature_group")]
    res = res.withColumns({c: F.col(c).try_cast("double") for c in num})
    if baseline_path:
        base = spark.read.option("header", True).csv(baseline_path)
        base = base.withColumns({c: F.col(c).try_cast("double") for c in base.columns
                                 if c not in ("dataset", "model_name", "feature_group")})
    else:
        base = res.where(F.col("feature_group") == "G6")
    return res, base
