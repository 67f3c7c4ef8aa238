"""Request audit log: spill replay and traffic roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.functions import values as V
from changetide.operators import ordered, stats


def unreplayed(spill: DataFrame, ids: Sequence[int] = ()) -> DataFrame:
    """Spilled rows to replay: the listed ones, else every unreplayed one."""
    return spill.where(F.col("id").isin(*ids)) if ids else spill.where(~F.col("replayed"))


def pending_spill(spill: DataFrame) -> DataFrame:
    return unreplayed(spill).agg(F.count(F.lit(1)).alias("pending"))


def newest_spill(spill: DataFrame, limit: int = 100) -> DataFrame:
    return spill.orderBy(F.col("spilled_at").desc(), F.col("id").desc()).limit(limit)


def replay_spill(spill: DataFrame, actor: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Audit rows rebuilt from spilled entries, and the spilled rows marked as replayed."""
    entry = V.parse_json(F.col("entry"))
    rows = spill.select(
        F.try_variant_get(entry, "$.api_key_id", "bigint").alias("api_key_id"),
        F.coalesce(V.text(entry, "endpoint"), F.lit("")).alias("endpoint"),
        F.coalesce(V.text(entry, "method"), F.lit("")).alias("method"),
        F.coalesce(F.try_variant_get(entry, "$.status_code", "int"), F.lit(0)).alias("status_code"),
        V.text(entry, "ip_address").alias("ip_address"),
        now.alias("timestamp"),
    )
    marked = spill.withColumns(
        {"replayed": F.lit(True), "replayed_by": F.lit(actor), "replayed_at": now}
    )
    return rows, marked


def request_latency(log: DataFrame, took: str, bounds: Sequence[float], percent: float = 95) -> DataFrame:
    """Per endpoint and method: counts of requests up to each bound, and an exact percentile."""
    by = ["endpoint", "method"]
    names = [f"le_{b:g}" for b in bounds]
    counts = log.groupBy(*by).agg(*(F.count_if(F.col(took) <= b).alias(n) for b, n in zip(bounds, names)))
    place = stats.percentiles(log, by, took, {"latency": percent})
    return ordered.attach(counts, place, by)


def request_rollup(log: DataFrame) -> DataFrame:
    """Requests, client errors and server errors per endpoint and method."""
    status = F.col("status_code")
    return log.groupBy("endpoint", "method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(status.between(400, 499)).alias("client_errors"),
        F.count_if(status >= 500).alias("server_errors"),
    )
