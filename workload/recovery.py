"""Dead letters, replay, checkpoints, lag, health, retention, audit."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from changetide.functions import origin
from changetide.operators import audit, deadletter, health, ingest, retention
from changetide.schemas import DEAD_LETTERS
from workload.samples import CDC, Registry, events, messages, millis, parsed, stored, table

queries = Registry()

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)

# Failed rows as letters: every seventh already replayed.
_LETTERS = CDC + """, f AS (SELECT event_id, topic, part, ts, operation, epoch_us(ts) AS us, event_id % 7 = 0 AS done
  FROM c WHERE event_type = 'error')
"""


def letters(spark, sf):
    rows = events(spark, sf).where("event_type = 'error'")
    placed = rows.select(
        F.lit("eventdb").alias("service_name"),
        origin.broker_location(
            "kafka",
            F.concat(F.lit("eventdb.public."), "event_type"),
            (F.col("user_id") % 6).cast("int"),
            F.col("event_id"),
        ).alias("p"),
        F.expr("CASE op WHEN 'd' THEN 'DELETE' WHEN 'u' THEN 'UPDATE' ELSE 'INSERT' END").alias("operation"),
        F.concat(F.lit('{"op":"c","n":'), "event_id", F.lit("}")).alias("raw_payload"),
        F.lit("boom").alias("error_message"),
        F.col("ts").alias("failed_at"),
        F.expr("event_id % 7 = 0").alias("is_replayed"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN ts END").alias("replayed_at"),
        F.lit(None).cast("string").alias("replay_error"),
    )
    return placed.select("service_name", "p.*", *DEAD_LETTERS.names[8:])


@queries.add(
    "dlq_capture",
    CDC
    + """SELECT topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CAST(event_id AS VARCHAR) AS broker_position, 'event time out of range' AS error_message FROM c WHERE event_id % 9 = 4""",
)
def dlq_capture(spark, sf):
    """Messages whose time lies beyond year 9999 become dead letters."""
    doc = F.concat(
        F.lit('{"op":"u","ts_ms":'),
        F.expr("CASE WHEN event_id % 9 = 4 THEN 999999999999999 ELSE unix_millis(ts) END"),
        F.lit("}"),
    )
    landed = events(spark, sf).select(
        F.concat(F.lit("eventdb.public."), "event_type").alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        doc.alias("value"),
    )
    _, failed = deadletter.split_errors(ingest.parse_messages(landed))
    return deadletter.dead_letters(failed, F.col("timestamp")).select(
        "broker_destination", "broker_substream", "broker_position", "error_message"
    )


@queries.add(
    "dlq_upsert_latest",
    _LETTERS
    + """SELECT CAST(event_id AS VARCHAR) AS broker_position,
  CASE WHEN event_id % 5 = 0 THEN 'again' ELSE 'boom' END AS error_message,
  CASE WHEN event_id % 5 = 0 THEN false ELSE done END AS is_replayed,
  CASE WHEN event_id % 5 = 0 THEN us + 1000000 ELSE us END AS failed_us FROM f""",
)
def dlq_upsert_latest(spark, sf):
    """A renewed failure replaces the entry and resets its replay state."""
    log = letters(spark, sf)
    renewed = log.where("kafka_offset % 5 = 0").withColumns(
        {
            "error_message": F.lit("again"),
            "failed_at": F.timestamp_micros(F.unix_micros("failed_at") + 1_000_000),
            "is_replayed": F.lit(False),
            "replayed_at": F.lit(None).cast("timestamp"),
        }
    )
    current = deadletter.latest_dead_letters(log.unionByName(renewed))
    return current.select(
        "broker_position", "error_message", "is_replayed", F.unix_micros("failed_at").alias("failed_us")
    )


@queries.add(
    "dlq_list",
    _LETTERS
    + """SELECT CAST(event_id AS VARCHAR) AS broker_position, us AS failed_us FROM f
WHERE NOT done ORDER BY ts DESC LIMIT 100""",
)
def dlq_list(spark, sf):
    return deadletter.list_letters(letters(spark, sf)).select(
        "broker_position", F.unix_micros("failed_at").alias("failed_us")
    )


@queries.add(
    "dlq_replay_batch",
    _LETTERS + """SELECT CAST(event_id AS VARCHAR) AS broker_position FROM f ORDER BY ts LIMIT 60""",
)
def dlq_replay_batch(spark, sf):
    return deadletter.replay_batch(letters(spark, sf), 60, include_replayed=True).select("broker_position")


@queries.add("dlq_pending", _LETTERS + "SELECT count(*) AS pending FROM f WHERE NOT done")
def dlq_pending(spark, sf):
    return deadletter.pending_count(letters(spark, sf))


@queries.add(
    "dlq_age_of_oldest",
    _LETTERS + "SELECT round((1706745600000000 - min(us)) / 1000000.0, 6) AS seconds FROM f WHERE NOT done",
)
def dlq_age_of_oldest(spark, sf):
    return deadletter.age_of_oldest(letters(spark, sf), NOW).select(F.round("seconds", 6).alias("seconds"))


def _replayable(spark, sf):
    """Letters that parse, are cut short, hold an impossible time, or are stored already."""
    raw = F.expr(
        """CASE WHEN kafka_offset % 11 = 1 THEN '{"cut'
        WHEN kafka_offset % 11 = 2 THEN '{"op":"c","ts_ms":999999999999999}' ELSE raw_payload END"""
    )
    rows = letters(spark, sf).withColumn("raw_payload", raw)
    known = rows.where("kafka_offset % 11 IN (3, 4)").select(
        F.col("kafka_topic").alias("topic"),
        F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"),
    )
    return rows, known


_STATUS = _LETTERS + """, r AS (SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed'
  WHEN 3 THEN 'duplicate' WHEN 4 THEN 'duplicate' ELSE 'replayed' END AS status FROM f)
"""


@queries.add(
    "dlq_replay_status",
    _STATUS + "SELECT CAST(event_id AS VARCHAR) AS broker_position, status FROM r",
)
def dlq_replay_status(spark, sf):
    rows, known = _replayable(spark, sf)
    _, outcome = deadletter.replay(rows, known)
    return outcome.select("broker_position", "status")


@queries.add(
    "dlq_replay_summary",
    _STATUS
    + """SELECT count(*) AS count, count(*) FILTER (status = 'replayed') AS replayed_count,
  count(*) FILTER (status = 'duplicate') AS duplicate_count, count(*) FILTER (status = 'skipped') AS skipped_count,
  count(*) FILTER (status = 'failed') AS failed_count FROM r""",
)
def dlq_replay_summary(spark, sf):
    rows, known = _replayable(spark, sf)
    return deadletter.replay_summary(deadletter.replay(rows, known)[1])


@queries.add(
    "dlq_replay_marks",
    _STATUS
    + """SELECT CAST(event_id AS VARCHAR) AS broker_position, status <> 'failed' AS is_replayed,
  CASE WHEN status = 'failed' THEN 'event time out of range' END AS replay_error,
  CASE WHEN status <> 'failed' THEN 1706745600000 END AS replayed_ms FROM r""",
)
def dlq_replay_marks(spark, sf):
    """State of the letters after a replay run."""
    rows, known = _replayable(spark, sf)
    _, outcome = deadletter.replay(rows, known)
    log = rows.unionByName(deadletter.replay_marks(rows, outcome, F.lit(NOW)))
    return deadletter.latest_dead_letters(log).select(
        "broker_position", "is_replayed", "replay_error", millis("replayed_at", "replayed_ms")
    )


@queries.add(
    "dlq_forward_headers",
    _LETTERS
    + """SELECT CAST(event_id AS VARCHAR) AS "offset", 'boom|' || topic || '|' || part || '|' || event_id AS headers FROM f""",
)
def dlq_forward_headers(spark, sf):
    """Headers of messages sent to a dead-letter topic."""
    sent = deadletter.forward_messages(letters(spark, sf))
    value = lambda i: F.col("headers")[i]["value"].cast("string")
    return sent.select(
        value(3).alias("offset"), F.concat_ws("|", *(value(i) for i in range(4))).alias("headers")
    )


@queries.add(
    "failed_deliveries",
    CDC
    + """SELECT CAST(event_id AS VARCHAR) AS broker_position, 'webhook' AS broker_kind,
  'Webhook delivery to https://hooks.example/' || user_id % 3 || ' failed: timeout' AS error_message
FROM g WHERE event_id % 6 = 1""",
)
def failed_deliveries(spark, sf):
    """Outbound deliveries that failed, as dead letters."""
    results = messages(spark, sf).where("offset % 6 = 1").select(
        "topic",
        "partition",
        "offset",
        F.concat(F.lit("https://hooks.example/"), F.col("partition") % 3).alias("url"),
        F.lit("timeout").alias("error_text"),
    )
    rows = deadletter.failed_deliveries(
        stored(spark, sf).drop("error"), results, F.col("event_time")
    )
    return rows.select("broker_position", "broker_kind", "error_message")


_POS = CDC + ", p AS (SELECT topic, part, max(event_id) AS last, count(*) AS n FROM m GROUP BY topic, part)\n"


@queries.add(
    "checkpoints_max",
    CDC
    + """SELECT 'audit' AS consumer_group, topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CAST(max(event_id) AS VARCHAR) AS broker_position, arg_max(ms, event_id) AS event_ms FROM m GROUP BY topic, part""",
)
def checkpoints_max(spark, sf):
    """Highest position per stream, compared as numbers."""
    return health.checkpoints(parsed(spark, sf), "audit").select(
        "consumer_group",
        "broker_destination",
        "broker_substream",
        "broker_position",
        millis("last_event_time", "event_ms"),
    )


def _checkpoints(spark, sf):
    rows = events(spark, sf).select(
        F.concat(F.lit("eventdb.public."), "event_type").alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("event_time"),
    )
    early = health.checkpoints(rows.where("offset < 3000"), "audit")
    late = health.checkpoints(rows.where("offset >= 3000 AND partition <> 5"), "audit")
    return early, late


@queries.add(
    "checkpoint_upsert",
    CDC
    + """SELECT topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CAST(max(event_id) AS VARCHAR) AS broker_position FROM c WHERE event_id < 3000 GROUP BY ALL""",
)
def checkpoint_upsert(spark, sf):
    """A batch's position replaces the stored one, even backwards."""
    early, late = _checkpoints(spark, sf)
    merged = health.upsert_checkpoints(late, early)
    return health.list_checkpoints(merged).select(
        "broker_destination", "broker_substream", "broker_position"
    )


@queries.add(
    "checkpoint_upsert_monotonic",
    CDC
    + """SELECT topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CAST(max(event_id) AS VARCHAR) AS broker_position FROM c WHERE part <> 5 OR event_id < 3000 GROUP BY ALL""",
)
def checkpoint_upsert_monotonic(spark, sf):
    early, late = _checkpoints(spark, sf)
    return health.upsert_checkpoints(late, early, monotonic=True).select(
        "broker_destination", "broker_substream", "broker_position"
    )


def _positions(spark, sf):
    rows = messages(spark, sf)
    ends = rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    read = (
        rows.where("value IS NOT NULL AND partition <> 4")
        .groupBy("topic", "partition")
        .agg((F.max("offset") - F.count(F.lit(1))).alias("position"))
    )
    return ends, read


_LAG = CDC + """, en AS (SELECT topic, part, max(event_id) + 1 AS e FROM c GROUP BY ALL),
rd AS (SELECT topic, part, max(event_id) - count(*) AS p FROM m WHERE part <> 4 GROUP BY ALL),
lg AS (SELECT topic, part, greatest(e - coalesce(p, 0), 0) AS lag FROM en LEFT JOIN rd USING (topic, part))
"""


@queries.add("partition_lag", _LAG + """SELECT topic, part AS "partition", lag FROM lg""")
def partition_lag(spark, sf):
    return health.partition_lag(*_positions(spark, sf))


@queries.add("total_lag", _LAG + "SELECT CAST(sum(lag) AS BIGINT) AS lag_total FROM lg")
def total_lag(spark, sf):
    return health.total_lag(health.partition_lag(*_positions(spark, sf)))


@queries.add(
    "commit_lag",
    CDC
    + """SELECT topic, part AS "partition", greatest(max(event_id) - min(event_id) - 1, 0) AS commit_lag FROM c GROUP BY ALL""",
)
def commit_lag(spark, sf):
    ends = messages(spark, sf).groupBy("topic", "partition").agg(
        F.max("offset").alias("highwater"), F.min("offset").alias("committed")
    )
    return health.commit_lag(ends)


def _clusters(spark, sf):
    """Runtime snapshot of three clusters, from the events of three tenants."""
    return events(spark, sf).groupBy(F.expr("concat('c', user_id % 3)").alias("cluster")).agg(
        F.lit(True).alias("running"),
        (F.max("value") > 0).alias("connected"),
        F.bool_or(F.expr("user_id % 3 = 2")).alias("reconnecting"),
        F.collect_set("event_type").alias("topics"),
        F.max(F.expr("CASE WHEN user_id % 3 = 1 THEN 'late' END")).alias("last_error"),
        F.max("ts").alias("last_message_at"),
        F.max(F.expr("CASE WHEN event_type = 'view' THEN ts END")).alias("last_commit_at"),
        F.count_if(F.expr("event_type = 'error'")).alias("lag_total"),
        F.max(F.expr("user_id % 3")).alias("dlq_messages"),
        F.max(F.expr("CASE WHEN user_id % 3 = 0 THEN 'half-open' ELSE 'closed' END")).alias("breaker_state"),
    )


@queries.add(
    "health_rollup",
    """SELECT 'healthy' AS status, true AS reconnecting, 'click,error,purchase,signup,view' AS topics,
  'c1: late' AS last_error, max(epoch_us(ts)) AS last_message_us,
  max(epoch_us(ts)) FILTER (event_type = 'view') AS last_commit_us,
  count(*) FILTER (event_type = 'error') AS lag_total, 2 AS dlq_messages, 'half-open' AS breaker_state,
  false AS ready FROM events""",
)
def health_rollup(spark, sf):
    """All clusters in one row, with the readiness verdict."""
    row = health.readiness(health.health_rollup(_clusters(spark, sf), F.lit(NOW)))
    return row.select(
        "status",
        "reconnecting",
        F.array_join("topics", ",").alias("topics"),
        "last_error",
        F.unix_micros("last_message_at").alias("last_message_us"),
        F.unix_micros("last_commit_at").alias("last_commit_us"),
        F.col("lag_total").cast("bigint").alias("lag_total"),
        F.col("dlq_messages").cast("int").alias("dlq_messages"),
        "breaker_state",
        "ready",
    )


def _outcomes(spark, sf):
    return events(spark, sf).select(
        F.expr("concat('t', user_id % 3)").alias("service_name"),
        F.expr("CASE op WHEN 'd' THEN 'DELETE' WHEN 'u' THEN 'UPDATE' ELSE 'INSERT' END").alias("operation"),
        F.expr(
            "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 10 = 0 THEN 'duplicate' ELSE 'processed' END"
        ).alias("outcome"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'schema' END").alias("error_type"),
    )


@queries.add(
    "ingestion_counters",
    CDC
    + """SELECT 't' || user_id % 3 AS service_name, operation, count(*) AS consumed,
  count(*) FILTER (event_type <> 'error' AND event_id % 10 <> 0) AS processed,
  count(*) FILTER (event_type <> 'error' AND event_id % 10 = 0) AS duplicate,
  count(*) FILTER (event_type = 'error') AS failed FROM c GROUP BY ALL""",
)
def ingestion_counters(spark, sf):
    return health.ingestion_counters(_outcomes(spark, sf))


@queries.add(
    "failure_counts",
    """SELECT 't' || user_id % 3 AS service_name, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'schema' END AS error_type,
  count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY ALL""",
)
def failure_counts(spark, sf):
    return health.failure_counts(_outcomes(spark, sf))


POLICY = retention.Policy("orders", "o_orderdate", 365)
ORDERS_NOW = datetime(1997, 6, 15, tzinfo=timezone.utc)


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@queries.add(
    "retention_expired",
    "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-15 00:00:00'",
)
def retention_expired(spark, sf):
    return retention.expired_rows(_orders(spark, sf), POLICY, ORDERS_NOW).select("o_orderkey")


@queries.add(
    "retention_kept",
    """SELECT o_orderkey FROM orders
WHERE NOT (o_orderdate < TIMESTAMP '1996-06-15 00:00:00' AND o_orderstatus = 'F')""",
)
def retention_kept(spark, sf):
    """A policy with an extra condition."""
    policy = retention.Policy("orders", "o_orderdate", 365, "o_orderstatus = 'F'")
    return retention.kept_rows(_orders(spark, sf), policy, ORDERS_NOW).select("o_orderkey")


@queries.add(
    "retention_summary",
    """SELECT 'orders' AS "table", count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-15') AS expired,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1996-06-15') AS kept FROM orders""",
)
def retention_summary(spark, sf):
    return retention.retention_summary(_orders(spark, sf), POLICY, ORDERS_NOW)


@queries.add(
    "retention_months",
    """SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders
WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH <= TIMESTAMP '1996-06-15'""",
)
def retention_months(spark, sf):
    """Whole months that end before the cutoff."""
    months = _orders(spark, sf).select(retention.month_of(F.col("o_orderdate")).alias("month")).distinct()
    return retention.expired_months(months, datetime(1996, 6, 15, tzinfo=timezone.utc))


@queries.add(
    "archive_rows",
    """SELECT '19970615' AS archive_date, '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' ||
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '","o_orderstatus":"' || o_orderstatus || '"}' AS value
FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-15 00:00:00'""",
)
def archive_rows(spark, sf):
    rows = retention.expired_rows(_orders(spark, sf), POLICY, ORDERS_NOW)
    return retention.archive_rows(rows.select("o_orderkey", "o_orderdate", "o_orderstatus"), ORDERS_NOW)


@queries.add(
    "fill_broker_columns",
    _LETTERS
    + """SELECT 'kafka' AS broker_kind, topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CASE WHEN event_id % 2 = 0 THEN 'kept' ELSE CAST(event_id AS VARCHAR) END AS broker_position FROM f""",
)
def fill_broker_columns(spark, sf):
    """Old rows without broker columns get them from their aliases."""
    old = letters(spark, sf).withColumns(
        {
            "broker_kind": F.lit(None).cast("string"),
            "broker_destination": F.lit(None).cast("string"),
            "broker_substream": F.lit(None).cast("string"),
            "broker_position": F.expr("CASE WHEN kafka_offset % 2 = 0 THEN 'kept' END"),
        }
    )
    return retention.fill_broker_columns(old).select(
        "broker_kind", "broker_destination", "broker_substream", "broker_position"
    )


def _spill(spark, sf):
    """Spilled request entries, one per event; some lack members."""
    entry = F.expr(
        """CASE WHEN event_id % 4 = 0 THEN '{"endpoint":"/events"}'
        ELSE to_json(named_struct('api_key_id', user_id, 'endpoint', concat('/', event_type), 'method', 'GET',
             'status_code', 200 + event_id % 5 * 100, 'ip_address', '10.0.0.1')) END"""
    )
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        entry.alias("entry"),
        F.lit("flush").alias("error_message"),
        F.col("ts").alias("spilled_at"),
        F.expr("event_id % 3 = 0").alias("replayed"),
        F.lit(None).cast("string").alias("replayed_by"),
        F.lit(None).cast("timestamp").alias("replayed_at"),
    )


_AUDIT = """WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS api_key_id,
  CASE WHEN event_id % 4 = 0 THEN '/events' ELSE '/' || event_type END AS endpoint,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'GET' END AS method,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(200 + event_id % 5 * 100 AS INTEGER) END AS status_code
  FROM events WHERE event_id % 3 <> 0)
"""


@queries.add(
    "spill_replay",
    _AUDIT + "SELECT api_key_id, endpoint, method, status_code, count(*) AS n FROM a GROUP BY ALL",
)
def spill_replay(spark, sf):
    """Unreplayed entries back as audit rows, with defaults for absent members."""
    rows, _ = audit.replay_spill(audit.unreplayed(_spill(spark, sf)), "admin", F.lit(NOW))
    return rows.groupBy("api_key_id", "endpoint", "method", "status_code").agg(F.count(F.lit(1)).alias("n"))


@queries.add(
    "spill_marked",
    """SELECT event_id AS id, true AS replayed, 'admin' AS replayed_by, 1706745600000 AS replayed_ms
FROM events WHERE event_id IN (5, 6, 7)""",
)
def spill_marked(spark, sf):
    """Replay of listed ids."""
    _, marked = audit.replay_spill(audit.unreplayed(_spill(spark, sf), (5, 6, 7)), "admin", F.lit(NOW))
    return marked.select("id", "replayed", "replayed_by", millis("replayed_at", "replayed_ms"))


@queries.add("spill_pending", "SELECT count(*) AS pending FROM events WHERE event_id % 3 <> 0")
def spill_pending(spark, sf):
    return audit.pending_spill(_spill(spark, sf))


@queries.add(
    "spill_newest", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30"
)
def spill_newest(spark, sf):
    return audit.newest_spill(_spill(spark, sf), 30).select("id")


@queries.add(
    "request_rollup",
    _AUDIT
    + """SELECT endpoint, method, count(*) AS requests, count(*) FILTER (status_code BETWEEN 400 AND 499) AS client_errors,
  count(*) FILTER (status_code >= 500) AS server_errors FROM a GROUP BY ALL""",
)
def request_rollup(spark, sf):
    rows, _ = audit.replay_spill(audit.unreplayed(_spill(spark, sf)), "admin", F.lit(NOW))
    return audit.request_rollup(rows)


@queries.add(
    "request_latency",
    """WITH r AS (SELECT '/events/' || event_type AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, value AS ms FROM events)
SELECT endpoint, method, count(*) FILTER (ms <= 5) AS le_5, count(*) FILTER (ms <= 25) AS le_25,
  count(*) FILTER (ms <= 100) AS le_100, round(quantile_cont(ms, 0.95), 6) AS p95 FROM r GROUP BY ALL""",
)
def request_latency(spark, sf):
    """How long requests took, by endpoint: counts up to bounds and the 95th percentile."""
    log = events(spark, sf).select(
        F.concat(F.lit("/events/"), "event_type").alias("endpoint"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END").alias("method"),
        F.col("value").alias("ms"),
    )
    found = audit.request_latency(log, "ms", (5, 25, 100))
    return found.select("endpoint", "method", "le_5", "le_25", "le_100", F.round("latency", 6).alias("p95"))
