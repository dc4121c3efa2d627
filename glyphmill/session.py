"""Session helpers: one place for the settings that the plans in this package rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; each is applied only where the session has no explicit value of its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "glyphmill", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the launcher's own session is used instead."""
    builder = SparkSession.builder.appName(app).master(master or f"local[{os.cpu_count() or 2}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master without that setting (tests) a temporary one. Anything else would write to machines' own disks."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="glyphmill-")
    return _own_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several later steps read is computed once. Only for tables of a few narrow columns; they stay there under names of their own."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
