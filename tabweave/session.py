"""A session with the settings the library expects, and a folder for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "tabweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a whole address: spark.checkpoint.dir, or the one set by setCheckpointDir.

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        base = "file://" + tempfile.mkdtemp(prefix="tabweave-")
        spark.sparkContext.setCheckpointDir(base)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())  # a path without a scheme lies in the default file system
    whole = where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
