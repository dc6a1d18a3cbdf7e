"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="quern-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where none is set and driver and executors are one process (tests) a temporary folder."""
    sc = spark.sparkContext
    if found := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
    return _own()
