"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.session import checkpoint_dir


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a single-machine session without one uses a temporary folder."""
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    own = os.path.join(tempfile.gettempdir(), "changetide-llm") if alone else None
    return f"{checkpoint_dir(spark, own)}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet and read it again: later steps survive lost executors and repeat no work."""
    spark = frame.sparkSession
    path = folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drawn(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About so many rows, at most, chosen by a hash of keys: the same ones for the same table.

    The hash thins the table out first, so every task hands on its share of the sample only."""
    total = frame.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(2**40))
    thinned = frame.withColumn("__place", place).where(F.col("__place") < int(min(1.0, 1.3 * (rows + 30) / max(total, 1)) * 2**40))
    return thinned.orderBy("__place", *keys).limit(rows).drop("__place")


def columns_of(frame: DataFrame) -> list[Column]:
    """All columns, whatever their names are made of."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in frame.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
