"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary one that goes with
    the process; any other session is an error, for its executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="brindle-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        at = f"file://{_local[0]}"
    return f"{at.rstrip('/')}/brindle/{label}-{uuid.uuid4().hex}"
