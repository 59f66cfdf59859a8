"""Folders for stores that a query builds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stores-")
    return f"{base.rstrip('/')}/stores-{uuid.uuid4().hex[:12]}"
