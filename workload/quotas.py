"""Ingestion quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from changetide.operators import ordered, quota
from workload.samples import Registry, events

queries = Registry()

HOUR = 3600
TIES = ("event_id",)
# Small enough that the sample's groups are cut into slices.
SMALL = ordered.Slicing(hot_rows=20, parts=8, tie_rows=100)


def _arrivals(spark, sf):
    return events(spark, sf).select(
        "event_id",
        "ts",
        F.expr("concat('s', user_id % 2)").alias("service_name"),
        F.expr("CASE WHEN user_id % 4 = 3 THEN NULL ELSE concat('t', user_id % 4) END").alias("tenant_id"),
    )


_A = """WITH a AS (SELECT event_id, ts, 's' || user_id % 2 AS service_name,
  CASE WHEN user_id % 4 = 3 THEN NULL ELSE 't' || user_id % 4 END AS tenant_id,
  epoch_us(ts) // 3600000000 AS w FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY service_name, w ORDER BY ts, event_id) AS rn FROM a)
"""


@queries.add(
    "quota_drop",
    _A
    + """SELECT event_id, (service_name <> 's0' AND rn <= 3) OR (service_name = 's0' AND rn <= 5) AS allowed FROM s""",
)
def quota_drop(spark, sf):
    """First events of each source and hour, with an override."""
    decided = quota.apply_quota(
        _arrivals(spark, sf), arrival="ts", window_seconds=HOUR, tenant=None,
        source_limit=3, source_overrides={"s0": 5}, ties=TIES,
    )
    return decided.select("event_id", "allowed")


_TWO = _A + """, l AS (SELECT *, rn <= 5 AS ok FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, w, ok ORDER BY ts, event_id) AS tn FROM l),
d AS (SELECT event_id, service_name, tenant_id, w, ok AND (tenant_id IS NULL OR tenant_id = 't2' OR tn <= 2) AS allowed,
  CASE WHEN NOT ok THEN 'source' WHEN tenant_id IS NOT NULL AND tenant_id <> 't2' AND tn > 2 THEN 'tenant' END AS dimension
  FROM t)
"""


def _two(spark, sf, slicing=SMALL):
    return quota.apply_quota(
        _arrivals(spark, sf), arrival="ts", window_seconds=HOUR, source_limit=5,
        tenant_limit=2, tenant_overrides={"t2": 0}, ties=TIES, slicing=slicing,
    )


@queries.add(
    "quota_two_stage",
    _TWO
    + """SELECT event_id, allowed, dimension,
  CASE dimension WHEN 'source' THEN service_name WHEN 'tenant' THEN tenant_id END AS quota_key,
  CASE dimension WHEN 'source' THEN 5 WHEN 'tenant' THEN 2 END AS quota_limit FROM d""",
)
def quota_two_stage(spark, sf):
    """Source stage, then tenant stage on what it let through; hot groups are sliced."""
    return _two(spark, sf).select("event_id", "allowed", "dimension", "quota_key", "quota_limit")


@queries.add(
    "quota_drop_counts",
    _TWO
    + """SELECT dimension, CASE dimension WHEN 'source' THEN service_name ELSE tenant_id END AS quota_key, count(*) AS dropped
FROM d WHERE NOT allowed GROUP BY 1, 2""",
)
def quota_drop_counts(spark, sf):
    return quota.drop_counts(_two(spark, sf))


@queries.add(
    "quota_window_counts",
    _TWO
    + """SELECT 'source' AS dimension, service_name AS identity, w * 3600000 AS window_ms, count(*) AS event_count
FROM d WHERE allowed OR dimension <> 'source' GROUP BY ALL
UNION ALL SELECT 'tenant', tenant_id, w * 3600000, count(*) FROM d WHERE allowed AND tenant_id IS NOT NULL GROUP BY ALL""",
)
def quota_window_counts(spark, sf):
    """Slots used per window: a tenant drop still uses up its source's slot."""
    counts = quota.window_counts(_two(spark, sf), arrival="ts", window_seconds=HOUR)
    return counts.select(
        "dimension", "identity", F.unix_millis("window_start").alias("window_ms"), "event_count"
    )


@queries.add(
    "quota_carried_over",
    _A
    + """, b AS (SELECT *, event_id % 2 AS half FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY service_name, w ORDER BY half, ts, event_id) AS rn2 FROM b)
SELECT event_id, rn2 <= 4 AS allowed FROM f WHERE half = 1""",
)
def quota_carried_over(spark, sf):
    """The second half of the events meets the slots the first half used."""
    rows = _arrivals(spark, sf)
    rules = {"arrival": "ts", "window_seconds": HOUR, "tenant": None}
    first = quota.apply_quota(rows.where("event_id % 2 = 0"), source_limit=4, ties=TIES, **rules)
    used = quota.window_counts(first, **rules)
    second = quota.apply_quota(
        rows.where("event_id % 2 = 1"), source_limit=4, ties=TIES, carried=used, **rules
    )
    return second.select("event_id", "allowed")


@queries.add(
    "quota_release_schedule",
    """WITH a AS (SELECT event_id, 't' || user_id % 3 AS tenant, epoch_us(ts) // 1800000000 AS w,
  row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS n FROM events),
q AS (SELECT *, n % 2 AS r, n // 2 AS q FROM a),
x AS (SELECT *, q + max(w - q) OVER (PARTITION BY tenant, r ORDER BY q) AS rel FROM q)
SELECT event_id, rel * 1800000 AS release_ms, rel - w AS delay_windows FROM x""",
)
def quota_release_schedule(spark, sf):
    """Throttling two per half hour: the window every event is released in."""
    rows = events(spark, sf).select("event_id", "ts", F.expr("concat('t', user_id % 3)").alias("tenant"))
    planned = quota.release_schedule(
        rows, identity="tenant", limit=F.lit(2), arrival="ts", window_seconds=1800, ties=TIES,
        slicing=ordered.Slicing(hot_rows=3, parts=4, tie_rows=10),
    )
    return planned.select("event_id", F.unix_millis("release_window").alias("release_ms"), "delay_windows")
