"""Tables kept by key: stored in buckets of their key, so that merging a batch moves the batch alone.

A catalog table lies in a fixed number of buckets, each sorted by key. A merge joins the batch to it on
the key; Spark deals the batch out like the buckets and reads these where they are, and the merged rows
are written into buckets without another exchange. The merged table is complete before it takes the
name of the old one. Keys must not be null, and the number of buckets should not be below
``spark.sql.shuffle.partitions``, or Spark may think it better to deal out both sides anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Combine = Callable[[DataFrame, DataFrame], DataFrame]


def save(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Store rows, one per key, as the table of that name."""
    spread = rows.repartition(buckets, *keys)
    spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def newest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is later by ``order``; the incoming one if they are equal."""
    names = existing.columns
    both = existing.select(F.struct(*names).alias("old"), *keys).join(
        incoming.select(F.struct(*names).alias("new"), *keys), list(keys), "full_outer"
    )
    place = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in order))
    renewed = F.col("old").isNull() | (F.col("new").isNotNull() & (place("new") >= place("old")))
    return both.select(F.when(renewed, F.col("new")).otherwise(F.col("old")).alias("row")).select("row.*")


def merged(spark: SparkSession, name: str, incoming: DataFrame, combine: Combine) -> DataFrame:
    """The stored table with a batch merged in; nothing is written."""
    stored = spark.table(name)
    return combine(stored, incoming.select(*stored.columns)).select(*stored.columns)


def merge(
    spark: SparkSession, name: str, incoming: DataFrame, keys: Sequence[str], buckets: int, combine: Combine
) -> None:
    """Merge a batch with one row per key into the table of that name, which is made if there is none."""
    if not spark.catalog.tableExists(name):
        save(incoming, name, keys, buckets)
        return
    draft = f"{name}_{uuid.uuid4().hex}"
    rows = merged(spark, name, incoming, combine)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(draft)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {draft} RENAME TO {name}")


def database(spark: SparkSession, folder: str) -> str:
    """A new database whose tables lie in a folder; ``DROP DATABASE … CASCADE`` removes them with it."""
    name = f"changetide_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return name
