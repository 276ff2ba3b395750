"""The folder that driver and executors share, for what is written between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; in local mode, where that is unset, below a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-caseloom-work-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = f"file://{_own[0]}"
    return f"{named.rstrip('/')}/caseloom/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
