"""Helpers the operators of this folder share: tables and folders in the shared place, bounded Arrow batches, ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of rows that cross to Python in one Arrow batch; a longer row makes a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of a few numbers, or so many bytes of texts, for each file of a table between steps whose size is known before; so many files it has at least.
FILE_ROWS, ROW_BYTES, LEAST_FILES = 1 << 18, 24, 4


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that is deleted when the driver ends."""
    return scratch(spark, f"tabweave-{name}")


def files_for(rows: int) -> int:
    return max(LEAST_FILES, -(-rows // FILE_ROWS))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    rows: about how many of a few numbers it has. Its files then follow from that, where a session's shuffle partitions
    may be far more: each file costs tasks, requests to the store and, on local disks, processes that set its mode.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(files_for(rows))
    path = f"{new_folder(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Texts can be long, so Arrow batches are bounded by bytes. Spark reads this setting of the session when a plan
    starts to run, so it stays lowered; batches of rows that are short keep the session's bound on rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= size:
        spark.conf.set(key, size)


def valid(column: str) -> Column:
    """A column as a text. The rule of all operators that read words, tokens or characters: bytes that are no UTF-8 are
    read as U+FFFD, one for each that can't be part of a character."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z alone."""
    return F.translate(text, UPPER, LOWER)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df as a table sorted by these columns over all its partitions: `part` is a row's partition, `at` its place there from 0.

    Rows that agree in all of them are dealt out too, so a value that is frequent makes no partition large.
    """
    tie = F.monotonically_increasing_id()
    rows = df.withColumn("_tie", tie).repartitionByRange(parts(df.sparkSession), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    place = F.col("_place")
    rows = rows.withColumn("_place", F.monotonically_increasing_id())
    return written(rows.withColumn("part", F.shiftright(place, 33).cast("int")).withColumn("at", place.bitwiseAND((1 << 33) - 1)).drop("_place"), name)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `number`, its rows' places in this order from 0. The driver gets a count for each partition."""
    rows = in_order(df, name, *order)
    starts, before = [], 0
    for part, n in sorted(rows.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    return rows.join(F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long")), "part").withColumn("number", F.col("start") + F.col("at")).drop("part", "at", "start")
