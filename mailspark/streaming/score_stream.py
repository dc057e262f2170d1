"""Request-at-a-time scoring re-aimed as a Structured Streaming job.

Request JSON files arriving in a folder are scored (stateless) and appended
to a Parquet sink; a second query keeps running detection counts in
``complete`` mode.  Both use checkpoints in the shared checkpoint folder,
so a restarted job resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspark.operators.score import REQUEST_SCHEMA, score_v1


def request_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None,
                   multiline: bool = True) -> DataFrame:
    """Request files: one JSON document per file (``multiline``) or JSON lines."""
    r = spark.readStream.schema(REQUEST_SCHEMA).option("multiLine", multiline)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(in_dir)


def start_scoring(spark: SparkSession, model: PipelineModel, in_dir: str, out_dir: str, checkpoint: str,
                  available_now: bool = True, multiline: bool = True) -> StreamingQuery:
    """Score every request file once; output = L2 rows (append)."""
    scored = score_v1(request_stream(spark, in_dir, multiline=multiline), model)
    w = scored.writeStream.format("parquet").option("path", out_dir) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_counts(spark: SparkSession, model: PipelineModel, in_dir: str, query_name: str, checkpoint: str,
                 available_now: bool = True, multiline: bool = True) -> StreamingQuery:
    """Running malicious / legitimate counts (L4 as a stateful aggregate)."""
    scored = score_v1(request_stream(spark, in_dir, multiline=multiline), model)
    counts = scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    w = counts.writeStream.format("memory").queryName(query_name) \
        .option("checkpointLocation", checkpoint).outputMode("complete")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_running_counts(spark: SparkSession, score: PipelineModel | Callable[[DataFrame], DataFrame], in_dir: str, out_dir: str,
                         checkpoint: str, available_now: bool = True, multiline: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """L4 as a stateful stream: a request counts once, by ``email_id``, however
    often and late it is delivered.  After each batch the whole counts are written
    to ``out_dir`` under the batch's number, so a batch that runs again after a
    restart writes the same folder.  ``score`` is a fitted pipeline, or adds
    ``prediction`` to requests itself."""
    requests = request_stream(spark, in_dir, max_files_per_trigger, multiline).dropDuplicates(["email_id"])
    scored = score(requests) if callable(score) else score_v1(requests, score)
    counts = scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batch={number:09d}")

    w = counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counts after the last batch."""
    every = spark.read.option("basePath", out_dir).parquet(f"{out_dir}/batch=*")
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch").drop("batch")
