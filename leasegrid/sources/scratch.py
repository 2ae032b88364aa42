"""Where files go that one query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share, which spark.checkpoint.dir names. Only where
    all runs on one machine may that be unset, and is then a new folder of that machine."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        shared = tempfile.mkdtemp()
    return f"{shared}/{name}-{uuid.uuid4()}"
