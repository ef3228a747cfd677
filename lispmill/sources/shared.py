"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names. A session of one machine (``local``) that names none gets one of its own; on a
    cluster that is an error, as executors don't see each other's disks."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set(SETTING, path)
    return path.rstrip("/")
