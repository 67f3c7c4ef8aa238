"""Retention: which rows expire, their archive, and the rewrite of stored partitions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Rows older than ``days`` by ``column`` expire; zero or less turns the policy off."""

    name: str
    column: str
    days: int
    extra: str | None = None


# Tables under retention, the column that ages them and the default days.
POLICIES = (
    Policy("events", "capture_time", 30),
    Policy("column_changes", "changed_at", 30),
    Policy("dead_letter_events", "failed_at", 30),
    Policy("api_audit_logs", "timestamp", 90),
    Policy("api_audit_log_spill", "replayed_at", 30, "replayed"),
)


def month_of(ts: Column) -> Column:
    """Partition key of a timestamp."""
    return F.date_format(ts, "yyyyMM")


def _expired(policy: Policy, now: datetime) -> Column:
    if policy.days <= 0:
        return F.lit(False)
    old = F.col(policy.column) < F.lit(now - timedelta(days=policy.days))
    if policy.extra:
        old = old & F.expr(policy.extra)
    return F.coalesce(old, F.lit(False))


def expired_rows(df: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    return df.where(_expired(policy, now))


def kept_rows(df: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    return df.where(~_expired(policy, now))


def retention_summary(df: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    """Expired and kept counts of one table, in one pass."""
    return df.agg(
        F.count_if(_expired(policy, now)).alias("expired"),
        F.count_if(~_expired(policy, now)).alias("kept"),
    ).select(F.lit(policy.name).alias("table"), "expired", "kept")


def expired_months(months: DataFrame, cutoff: datetime) -> DataFrame:
    """Monthly partitions that end at or before the cutoff."""
    upper = F.add_months(F.to_date("month", "yyyyMM"), 1).cast("timestamp")
    return months.where(upper <= F.lit(cutoff))


def archive_rows(rows: DataFrame, now: datetime) -> DataFrame:
    """Rows as JSON lines stamped with the archive day."""
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(body.alias("value"), F.lit(now.strftime("%Y%m%d")).alias("archive_date"))


def write_archive(rows: DataFrame, path: str, now: datetime) -> int:
    """Append to ``path/archive_date=…`` as JSON lines; returns the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    archive_rows(rows, now).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(
        "archive_date"
    ).text(path)
    return seen.get["n"]


def remove_folders(spark: SparkSession, patterns: list[str]) -> None:
    """Delete the folders that match patterns, through the file system they lie in."""
    for pattern in patterns:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(where) or ():
            fs.delete(found.getPath(), True)


def _layout(df: DataFrame) -> list[str]:
    """By month, and by batch inside where batches are told apart."""
    return [c for c in ("month", "batch_id") if c in df.columns]


def _folders(path: str, rows: list) -> list[str]:
    return [path + "".join(f"/{name}={value}" for name, value in row.asDict().items()) for row in rows]


def drop_months(
    spark: SparkSession,
    path: str,
    cutoff: datetime,
    archive_to: str | None = None,
    now: datetime | None = None,
    rows: DataFrame | None = None,
) -> list[str]:
    """Drop whole months that end at or before the cutoff, archiving them first if asked to.

    rows: what counts as stored, where that is not all of ``path`` (a table with unfinished batches);
    folders of other batches stay, and their rows are neither archived nor dropped. Months are read off
    the folders, data only for the archive.
    """
    stored = spark.read.parquet(path) if rows is None else rows
    stored = stored.withColumn("month", F.col("month").cast("string"))
    folders = stored.select(*_layout(stored)).distinct().collect()
    folders = [r for r in folders if r.month and r.month.isdigit() and _month_end(r.month) <= cutoff.replace(tzinfo=None)]
    old = sorted({r.month for r in folders})
    if old and archive_to:
        expired = stored.where(F.col("month").isin(*old))
        if write_archive(expired, archive_to, now or cutoff) != expired.count():
            raise RuntimeError("archive is incomplete; nothing was dropped")
    remove_folders(spark, _folders(path, folders))
    return old


def _month_end(month: str) -> datetime:
    year, number = int(month[:4]), int(month[4:])
    return datetime(year + number // 12, number % 12 + 1, 1)


def rewrite_months(df: DataFrame, path: str, staging: str) -> None:
    """Replace the months (or their batches) ``df`` covers, although ``df`` may read from ``path``.

    Spark cannot overwrite what it reads, hence the stop in ``staging``.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*_layout(df)).parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *_layout(df)
    ).parquet(path)


def expire_boundary(
    spark: SparkSession, path: str, policy: Policy, now: datetime, staging: str,
    archive_to: str | None = None, rows: DataFrame | None = None,
) -> None:
    """Remove expired rows from the one month the cutoff falls into, archiving them first.

    rows: as for ``drop_months``."""
    if policy.days <= 0:
        return
    month = (now - timedelta(days=policy.days)).strftime("%Y%m")
    every = spark.read.parquet(path) if rows is None else rows
    stored = every.withColumn("month", F.col("month").cast("string")).where(F.col("month") == month)
    old = expired_rows(stored, policy, now)
    if archive_to and write_archive(old, archive_to, now) != old.count():
        raise RuntimeError("archive is incomplete; nothing was removed")
    kept = kept_rows(stored, policy, now)
    layout = _layout(stored)
    # a folder whose rows all expired is not among those that get rewritten
    emptied = stored.select(*layout).distinct().join(kept.select(*layout).distinct(), layout, "left_anti").collect()
    rewrite_months(kept, path, staging)
    remove_folders(spark, _folders(path, emptied))


def partition_by_month(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("month", month_of(F.col(column)))


def fill_broker_columns(letters: DataFrame) -> DataFrame:
    """Fill broker-neutral columns of old rows from their Kafka aliases."""
    fills = {
        "broker_kind": F.lit("kafka"),
        "broker_destination": F.col("kafka_topic"),
        "broker_substream": F.col("kafka_partition").cast("string"),
        "broker_position": F.col("kafka_offset").cast("string"),
    }
    return letters.withColumns({n: F.coalesce(F.col(n), v) for n, v in fills.items()})
