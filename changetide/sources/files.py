"""Landed messages, stored tables and their layout."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide import schemas
from changetide.operators import ingest
from changetide.operators.retention import partition_by_month, remove_folders


def read_messages(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Broker messages landed as JSON lines."""
    reader = (spark.readStream if stream else spark.read).schema(schemas.LANDED_MESSAGE)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def read_queue(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed queue messages in the shape of broker messages."""
    reader = (spark.readStream if stream else spark.read).schema(schemas.QUEUE_MESSAGE)
    return queue_messages(reader.json(path))


#: So many rows are parsed by one task, at most.
TASK_ROWS = 100_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Give a plain scan a task per core, and one per ``task_rows`` rows, for the costly parsing that follows.

    Rows are counted off the files first, because splits say little about them: one file of few row groups
    has as many splits as there are cores, and most of them are empty. A scan of more splits than that is
    left alone: no shuffle then. Rows are dealt out by their place in the scan, which needs no sort of the
    rows of a split, as dealing them round does.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(wanted, "_place").drop("_place")


def queue_messages(rows: DataFrame) -> DataFrame:
    """A queue has one partition, and its delivery tag is the offset."""
    return rows.select(
        F.col("queue").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("delivery_tag").alias("offset"),
        "timestamp",
        F.col("body").alias("value"),
    )


def legacy_messages(rows: DataFrame, topic: str = "legacy") -> DataFrame:
    """Raw (id, value) rows in the shape of broker messages; the id is the position."""
    return rows.select(
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        "value",
    )


def backfill_legacy(rows: DataFrame, stored: DataFrame, topic: str = "legacy") -> DataFrame:
    """Events for the raw rows that are not stored yet."""
    missing = legacy_messages(rows, topic).join(
        stored.select("topic", "partition", "offset"), ["topic", "partition", "offset"], "left_anti"
    )
    return ingest.parse_messages(missing)


def write_table(df: DataFrame, path: str, time: str, mode: str = "append") -> None:
    """Store by month, clustered inside each month so that file statistics can skip.

    Rows are range-partitioned by month and time: files come out even although one month, or one
    source, may hold most of the rows. Ranges take a look at all rows before they are dealt out, so rows are
    stored beside the table as they come, and computed once.
    """
    landing = f"{path}_landing_{uuid.uuid4().hex}"
    try:
        df.write.parquet(landing)
        landed = df.sparkSession.read.schema(df.schema).parquet(landing)
        laid_out = partition_by_month(landed, time).repartitionByRange("month", time).sortWithinPartitions("month", time)
        laid_out.write.mode(mode).partitionBy("month").parquet(path)
    finally:
        remove_folders(df.sparkSession, [landing])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its month as text."""
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
