"""Working folders that driver and executors share: kept indexes, round trips of writers and readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def workdir(spark: SparkSession, tag: str) -> str:
    """A fresh path in this application's part of spark.checkpoint.dir; what is left there goes when the driver's JVM ends.

    Where the setting is missing, a local master gets a temporary folder; other masters raise, as executors
    wouldn't see a folder of the driver's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cliploom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/cliploom-{spark.sparkContext.applicationId}")
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(home):
        fs.mkdirs(home)
        fs.deleteOnExit(home)
    return f"{home}/{tag}-{uuid.uuid4().hex}"
