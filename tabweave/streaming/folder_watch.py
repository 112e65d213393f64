"""Watching a folder: new files as a stream, and what has come, changed and gone by comparing listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabweave.sources.files import collect_files

STABLE_SECONDS = 2.5


def stream_folder(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000, pattern: str = "*.csv") -> DataFrame:
    """New delimited files below a folder as an unbounded table of texts with their path."""
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder).withColumn("__path", F.col("_metadata.file_path"))


def on_new_files(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls act with each batch of what has come so far, then ends; started again, it goes on where it ended."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("csv", "tsv", "json", "xlsx", "parquet"), stable_seconds: float = STABLE_SECONDS) -> DataFrame:
    """Files below a folder that haven't changed for a while."""
    return collect_files(spark, folder, extensions).where(F.unix_micros(F.current_timestamp()) - F.unix_micros("changed") >= int(stable_seconds * 1e6))


def poll(spark: SparkSession, folder: str, state: str, extensions: tuple[str, ...] = ("csv", "tsv", "json", "xlsx", "parquet"), stable_seconds: float = STABLE_SECONDS) -> DataFrame:
    """(path, change) since the last poll that kept its listing below `state`; the first one tells of nothing.

    A file that was written within the last stable_seconds waits for a later poll, however often it is written until then.
    The listing is kept before the changes are returned, so a change is told once. A row for each file is written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []
    now = collect_files(spark, folder, extensions)
    settled = F.unix_micros(F.current_timestamp()) - F.unix_micros("changed") >= int(stable_seconds * 1e6)
    if not kept:
        now.write.parquet(f"{state}/0")  # what is there already counts as seen
        return spark.createDataFrame([], "path string, change string")
    before = spark.read.parquet(f"{state}/{kept[-1]}")
    restless = now.where(~settled).select("path")
    after = now.where(settled).union(before.join(restless, "path", "left_semi").select(*now.columns))
    after.write.parquet(f"{state}/{kept[-1] + 1}")
    return changes(before, spark.read.parquet(f"{state}/{kept[-1] + 1}"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, changed or removed."""
    a, b = before.select("path", F.struct("size", "changed").alias("was")), after.select("path", F.struct("size", "changed").alias("now"))
    joined = a.join(b, "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")
