"""Ingestion quotas per source and tenant: dropping, and a release schedule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.operators import ordered
from changetide.schemas import POSITION_ORDER

_IDLE_GROUPS = 4096


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window, aligned to the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def limit_of(identity: Column, default: int, overrides: Mapping[str, int] | None = None) -> Column:
    """Configured limit of an identity; zero or less means unlimited."""
    chosen = F.lit(default)
    for name, limit in (overrides or {}).items():
        chosen = F.when(identity == name, F.lit(limit)).otherwise(chosen)
    return chosen


def _limits_anything(default: int, overrides: Mapping[str, int] | None) -> bool:
    return default > 0 or any(limit > 0 for limit in (overrides or {}).values())


def _admit(
    df: DataFrame,
    dimension: str,
    identity: Column,
    limit: Column,
    eligible: Column,
    arrival: str,
    ties: Sequence[str],
    seconds: int,
    slicing: ordered.Slicing,
    carried: DataFrame | None,
    arrived: DataFrame,
) -> DataFrame:
    """Add ``_ok_<dimension>``: first ``limit`` eligible rows per identity and window.

    Rows the rule does not concern are spread over many idle groups instead of forming one. Cuts are made
    from all that arrived, so that no earlier stage has to be run for them.
    """
    keys = ["_identity", "_window", "_idle"]

    def staged(rows: DataFrame, able: Column) -> DataFrame:
        counted = able & identity.isNotNull() & (limit > 0)
        return rows.withColumns(
            {
                "_counted": counted,
                "_identity": F.when(counted, identity),
                "_window": F.when(counted, window_start(F.col(arrival), seconds)),
                "_idle": F.when(counted, F.lit(-1)).otherwise(
                    F.pmod(F.xxhash64(arrival, *ties), F.lit(_IDLE_GROUPS)).cast("int")
                ),
                "_limit": limit,
                "_order": F.unix_micros(arrival),
            }
        )

    like = staged(arrived, F.lit(True))
    ranked = ordered.row_number(staged(df, eligible), keys, "_order", "_rank", ties, slicing, like)
    used = F.lit(0)
    if carried is not None:
        earlier = carried.where(F.col("dimension") == dimension).select(
            F.col("identity").alias("_identity"),
            F.col("window_start").alias("_window"),
            F.col("event_count").alias("_used"),
        )
        ranked = ordered.attach(ranked, earlier, ["_identity", "_window"])
        used = F.coalesce(F.col("_used"), F.lit(0))
    admitted = ~F.col("_counted") | (F.col("_rank") + used <= F.col("_limit"))
    return ranked.withColumn("_ok_" + dimension, admitted).select(*df.columns, "_ok_" + dimension)


def apply_quota(
    events: DataFrame,
    *,
    arrival: str,
    window_seconds: int,
    source: str = "service_name",
    tenant: str | None = "tenant_id",
    source_limit: int = 0,
    source_overrides: Mapping[str, int] | None = None,
    tenant_limit: int = 0,
    tenant_overrides: Mapping[str, int] | None = None,
    ties: Sequence[str] = POSITION_ORDER,
    carried: DataFrame | None = None,
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """Decide every event: columns allowed, dimension, quota_key, quota_limit.

    The source stage runs first and uses up a slot even when the tenant stage then drops the
    event; the tenant stage counts only events the source stage let through. ``carried`` holds
    the counts earlier batches left in their windows (schema ``QUOTA_WINDOWS``).
    """
    source_cap = limit_of(F.col(source), source_limit, source_overrides)
    if _limits_anything(source_limit, source_overrides):
        decided = _admit(
            events, "source", F.col(source), source_cap, F.lit(True),
            arrival, ties, window_seconds, slicing, carried, events,
        )
    else:
        decided = events.withColumn("_ok_source", F.lit(True))
    dropped = F.when(~F.col("_ok_source"), F.struct(
        F.lit("source").alias("dimension"),
        F.col(source).cast("string").alias("quota_key"),
        source_cap.alias("quota_limit"),
    ))
    if tenant is not None and _limits_anything(tenant_limit, tenant_overrides):
        tenant_cap = limit_of(F.col(tenant), tenant_limit, tenant_overrides)
        decided = _admit(
            decided, "tenant", F.col(tenant), tenant_cap, F.col("_ok_source"),
            arrival, ties, window_seconds, slicing, carried, events,
        )
        dropped = F.coalesce(dropped, F.when(~F.col("_ok_tenant"), F.struct(
            F.lit("tenant").alias("dimension"),
            F.col(tenant).cast("string").alias("quota_key"),
            tenant_cap.alias("quota_limit"),
        )))
    return decided.withColumn("_dropped", dropped).select(
        *events.columns,
        F.col("_dropped").isNull().alias("allowed"),
        F.col("_dropped.dimension").alias("dimension"),
        F.col("_dropped.quota_key").alias("quota_key"),
        F.col("_dropped.quota_limit").alias("quota_limit"),
    )


def window_counts(
    decided: DataFrame,
    *,
    arrival: str,
    window_seconds: int,
    source: str = "service_name",
    tenant: str | None = "tenant_id",
) -> DataFrame:
    """Slots used per dimension, identity and window by a decided batch."""
    start = window_start(F.col(arrival), window_seconds)
    used = [
        F.struct(F.lit("source").alias("dimension"), F.col(source).cast("string").alias("identity"),
                 (F.col("allowed") | (F.col("dimension") != "source")).alias("counts"))
    ]
    if tenant is not None:
        used.append(
            F.struct(F.lit("tenant").alias("dimension"), F.col(tenant).cast("string").alias("identity"),
                     F.col("allowed").alias("counts"))
        )
    slots = decided.select(start.alias("window_start"), F.explode(F.array(*used)).alias("slot"))
    return (
        slots.where(F.col("slot.counts") & F.col("slot.identity").isNotNull())
        .groupBy("slot.dimension", "slot.identity", "window_start")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def merge_window_counts(*parts: DataFrame) -> DataFrame:
    """Add up slots used over batches."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("dimension", "identity", "window_start").agg(
        F.sum("event_count").alias("event_count")
    )


def drop_counts(decided: DataFrame) -> DataFrame:
    """Dropped events per dimension and identity."""
    return (
        decided.where(~F.col("allowed"))
        .groupBy("dimension", "quota_key")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def release_schedule(
    events: DataFrame,
    *,
    identity: str,
    limit: Column,
    arrival: str,
    window_seconds: int,
    ties: Sequence[str] = POSITION_ORDER,
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """Throttling as a schedule: the window each event is released in, first come first served.

    Per identity and window only a count is needed: the backlog at the start of a window follows
    from the counts before it (running sum minus its running minimum), and an event released
    from place ``backlog + rank`` waits that many windows divided by the limit. No event is ever
    dropped. Adds release_window and delay_windows.
    """
    width = window_seconds * 1_000_000
    staged = events.withColumns(
        {
            "_limit": limit.cast("bigint"),
            "_w": F.floor(F.unix_micros(arrival) / width),
            "_order": F.unix_micros(arrival),
        }
    )
    free = staged.where((F.col("_limit") <= 0) | F.col(identity).isNull())
    bound = staged.where((F.col("_limit") > 0) & F.col(identity).isNotNull())
    keys = [identity, "_w"]
    ranked = ordered.row_number(bound, keys, "_order", "_rank", ties, slicing)

    by_time = W.partitionBy(identity).orderBy("_w")
    upto = by_time.rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = bound.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_l")
    )
    # Net load a window passes on, after the capacity up to the next busy window.
    load = F.col("_n") - F.col("_l") * (F.lead("_w").over(by_time) - F.col("_w"))
    walk = counts.withColumn("_x", load).withColumn("_s", F.sum("_x").over(upto))
    after = F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto))
    backlog = walk.withColumn("_after", after).select(
        *keys, F.coalesce(F.lag("_after").over(by_time), F.lit(0)).alias("_backlog")
    )
    placed = ordered.attach(ranked, backlog, keys)
    delay = F.floor((F.col("_backlog") + F.col("_rank") - 1) / F.col("_limit"))

    def shaped(df: DataFrame, waits: Column) -> DataFrame:
        return df.select(
            *events.columns,
            F.timestamp_micros(((F.col("_w") + waits) * width).cast("bigint")).alias("release_window"),
            waits.cast("bigint").alias("delay_windows"),
        )

    return shaped(placed, delay).unionByName(shaped(free, F.lit(0).cast("bigint")))
