"""A SparkSession set up for the engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import ConfigurationError

#: Settings that the dialect's semantics rest on.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.orderByOrdinal": "false",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.groupByAliases": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Settings for speed at any scale; a cluster's own settings win.
EXECUTION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.runtimeFilter.enabled": "true",
}


def build_session(app: str = "lakemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` come last."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master.partition("[")[2].rstrip("]") or "1"
            builder = builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8) if cores == "*" else cores)
    for key, value in (EXECUTION | SEMANTICS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; it goes when the driver ends.

    Only a local session (one machine) may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        base = tempfile.gettempdir()
    at = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{at}/table"
