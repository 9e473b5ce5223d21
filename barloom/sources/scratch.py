"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is unset on a local master, a
    temporary folder that is kept for the session.  Elsewhere that is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told
