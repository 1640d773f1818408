"""A folder that driver and executors share, for queries that write what they read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new name in the folder in spark.checkpoint.dir; where that is unset, in one of our own in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='lyrebird-')}/{name}-{uuid.uuid4().hex}"
