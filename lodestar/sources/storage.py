"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str = "run") -> str:
    """A new folder within the one that the session names for checkpoints (``spark.checkpoint.dir``).  Where it
    names none a local folder is made, but only if driver and executors are one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        handle = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = handle.get() if handle.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-run-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
