"""Shared folder for tables that cut lineage or carry staged results, and the bound on Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint where the cluster says; set a folder only when none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(root or work_dir(spark, "checkpoint"))


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the cluster's checkpoint folder; a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tunekit-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Let Arrow batches hold a few megabytes at most (of rows; a longer row is alone).

    Rows are whole texts, so a bound on rows alone would make a worker's memory follow their length. The
    setting is the session's (the active one's, if none is given), as plans are carried out after they are
    built; a lower one stays.
    """
    spark = spark or SparkSession.active()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    java = spark._jsparkSession.sessionState().conf()
    if java.arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
