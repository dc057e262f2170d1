"""Spark session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "mailspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, UTC time zone, Arrow and no web UI.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[N]``.  The shuffle partition count defaults to 2x cores locally;
    on a cluster AQE coalesces from whatever the deployment sets.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions is None and master and master.startswith("local"):
        n = master[master.find("[") + 1:-1] if "[" in master else "1"
        cores = (os.cpu_count() or 8) if n == "*" else int(n)
        shuffle_partitions = max(8, 2 * int(cores))
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # broadcast only what the planner can prove small (10 MB default)
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset (local tests) a scratch
    folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc_dir = spark.sparkContext.getCheckpointDir()
        if sc_dir:
            return sc_dir
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="mailspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for intermediate
    files (never a machine-local temporary folder)."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/mailspark-scratch/{name}-{uuid.uuid4().hex[:12]}"
