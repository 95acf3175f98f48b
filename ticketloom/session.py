"""Spark session with the settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Payload parsing is CPU-heavy, so small shuffles must not end up in one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Call sites of every column call are not needed and slow plan building down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "ticketloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder for checkpoints: the cluster's own setting wins, the fallback is for tests only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = configured or fallback or os.environ.get("TICKETLOOM_CHECKPOINT_DIR")
    if not target:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    spark.sparkContext.setCheckpointDir(target)
    return target


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that the cluster names in spark.checkpoint.dir. Only a local
    session, where driver and tasks are one process, may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        root = tempfile.mkdtemp(prefix="ticketloom-")
    return f"{root.rstrip('/')}/ticketloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: later passes see the same rows, and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
