"""2.M: sinks.  Parquet is the storage format; CSV and JSON are exports.

Every writer targets a new folder (never in place) and writes in parallel
(one file per task), which replaces the reference's file-per-mail output.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """M1/M2/M5/M7: Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """M1/M2 export: CSV with a header row (scalar columns only)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """M3/M4: feature documents as JSON lines (many documents per file)."""
    docs.write.mode(mode).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """M6: model bundle = PipelineModel folder (the assembler holds the feature list)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A16."""
    return PipelineModel.load(path)


def save_importance(importance: DataFrame, path: str) -> None:
    """I5 / M7."""
    importance.write.mode("overwrite").parquet(path)


def load_importance(spark: SparkSession, path: str) -> DataFrame:
    """I5."""
    return spark.read.parquet(path)
