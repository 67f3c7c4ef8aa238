"""Consumer positions, lag, cluster roll-ups, readiness and ingestion counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.functions import origin
from changetide.operators.catalog import upsert
from changetide.schemas import CHECKPOINT_KEY, CHECKPOINTS

# Readiness thresholds.
MAX_COMMIT_AGE_SECONDS = 300
MAX_LAG = 1000
MAX_DEAD_LETTERS = 0


def checkpoints(events: DataFrame, consumer_group: str, broker_kind: str = "kafka") -> DataFrame:
    """Highest position per stream, with the event time found there."""
    kafka = broker_kind == "kafka"
    known = events.where(
        F.col("topic").isNotNull()
        & F.col("offset").isNotNull()
        & (F.col("partition").isNotNull() if kafka else F.lit(True))
    )
    stream = ["topic", "partition"] if kafka else ["topic"]
    top = known.groupBy(*stream).agg(
        F.max("offset").alias("offset"), F.max_by("event_time", "offset").alias("last_event_time")
    )
    partition = F.col("partition") if kafka else F.lit(None).cast("int")
    place = origin.broker_location(broker_kind, F.col("topic"), partition, F.col("offset"))
    return top.select(
        F.lit(consumer_group).alias("consumer_group"), place.alias("p"), "last_event_time"
    ).select("consumer_group", "p.*", "last_event_time")


def upsert_checkpoints(
    existing: DataFrame, incoming: DataFrame, monotonic: bool = False
) -> DataFrame:
    """Replace positions by the batch's; ``monotonic`` never moves one back."""
    old, new = existing.select(*CHECKPOINTS.names), incoming.select(*CHECKPOINTS.names)
    if not monotonic:
        return upsert(old, new, CHECKPOINT_KEY)
    both = old.unionByName(new)
    return (
        both.groupBy(*CHECKPOINT_KEY)
        .agg(F.max_by(F.struct(*both.columns), F.col("broker_position").try_cast("bigint")).alias("r"))
        .select("r.*")
    )


def list_checkpoints(table: DataFrame) -> DataFrame:
    shown = origin.shown_substream(F.col("broker_substream"))
    return table.orderBy(*CHECKPOINT_KEY).withColumn("broker_substream", shown)


def partition_lag(end_offsets: DataFrame, positions: DataFrame) -> DataFrame:
    """Messages not read yet per partition: end minus next position, at least 0.

    ``end_offsets``: topic, partition, end_offset; ``positions``: topic, partition, position.
    """
    return end_offsets.join(positions, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        F.greatest(F.col("end_offset") - F.coalesce("position", F.lit(0)), F.lit(0)).alias("lag"),
    )


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.sum("lag").alias("lag_total"))


def commit_lag(positions: DataFrame) -> DataFrame:
    """Read but not committed: highwater minus committed minus one, at least 0."""
    waiting = F.greatest(F.col("highwater") - F.col("committed") - 1, F.lit(0))
    return positions.select("topic", "partition", waiting.alias("commit_lag"))


def health_rollup(clusters: DataFrame, now: Column) -> DataFrame:
    """One row over all clusters' runtime snapshots.

    Input: cluster, running, connected, reconnecting, topics, last_error, last_message_at,
    last_commit_at, lag_total, dlq_messages, breaker_state. There is one row per cluster.
    """
    worst = {"open": 2, "half-open": 1}
    rank = F.lit(0)
    for state, level in worst.items():
        rank = F.when(F.col("breaker_state") == state, level).otherwise(rank)
    rolled = clusters.agg(
        F.coalesce(F.bool_and("running"), F.lit(False)).alias("running"),
        F.coalesce(F.bool_and("connected"), F.lit(False)).alias("connected"),
        F.coalesce(F.bool_or(F.coalesce("reconnecting", F.lit(False))), F.lit(False)).alias("reconnecting"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"),
        F.array_sort(
            F.collect_list(F.when(F.col("last_error") != "", F.concat("cluster", F.lit(": "), "last_error")))
        ).alias("_errors"),
        F.max("last_message_at").alias("last_message_at"),
        F.max("last_commit_at").alias("last_commit_at"),
        F.coalesce(F.sum("lag_total"), F.lit(0)).alias("lag_total"),
        F.coalesce(F.max("dlq_messages"), F.lit(0)).alias("dlq_messages"),
        F.max(rank).alias("_rank"),
    )
    age = F.greatest((F.unix_micros(now) - F.unix_micros("last_commit_at")) / 1_000_000, F.lit(0.0))
    return rolled.select(
        F.when(F.col("running") & F.col("connected"), "healthy").otherwise("unhealthy").alias("status"),
        "running",
        "connected",
        "reconnecting",
        "topics",
        F.when(F.size("_errors") > 0, F.array_join("_errors", "; ")).alias("last_error"),
        "last_message_at",
        "last_commit_at",
        age.alias("last_commit_age_seconds"),
        "lag_total",
        "dlq_messages",
        F.when(F.col("_rank") == 2, "open").when(F.col("_rank") == 1, "half-open").otherwise("closed").alias("breaker_state"),
    )


def readiness(
    health: DataFrame,
    max_commit_age: float = MAX_COMMIT_AGE_SECONDS,
    max_lag: int = MAX_LAG,
    max_dead_letters: int = MAX_DEAD_LETTERS,
) -> DataFrame:
    """Add ``ready`` to a health row."""
    never_committed = (
        F.col("last_message_at").isNotNull() & F.col("last_commit_at").isNull() & (F.col("lag_total") > 0)
    )
    too_old = F.coalesce(F.col("last_commit_age_seconds") > max_commit_age, F.lit(False))
    ready = (
        F.col("running")
        & F.col("connected")
        & ~never_committed
        & ~too_old
        & (F.col("lag_total") <= max_lag)
        & (F.col("dlq_messages") <= max_dead_letters)
    )
    return health.withColumn("ready", ready)


def ingestion_counters(outcomes: DataFrame) -> DataFrame:
    """Consumed, processed, duplicate and failed counts per service and operation.

    Input: service_name, operation, outcome (processed, duplicate, failed) and error_type.
    """
    return outcomes.groupBy("service_name", "operation").agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def outcome_counters(prepared: DataFrame, stored: DataFrame) -> DataFrame:
    """Consumed, processed, duplicate and failed events of a batch by service.

    prepared: the batch as parsed, with ``error``; stored: the events it added. What neither failed nor
    was added had a known position, or came twice in the batch."""
    seen = prepared.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("consumed"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    added = stored.groupBy(F.col("service_name").alias("_service")).agg(F.count(F.lit(1)).alias("_added"))
    processed = F.coalesce("_added", F.lit(0))
    return seen.join(added, F.col("service_name").eqNullSafe(F.col("_service")), "left").select(
        "service_name",
        "consumed",
        processed.alias("processed"),
        (F.col("consumed") - F.col("failed") - processed).alias("duplicate"),
        "failed",
    )


def failure_counts(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("outcome") == "failed")
        .groupBy("service_name", "error_type")
        .agg(F.count(F.lit(1)).alias("failed"))
    )
