"""Parsing, filtering, masking and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from changetide.functions import origin, parsing, values
from changetide.operators import ingest
from changetide.sources import files, manifest
from workload.samples import (
    CDC,
    Registry,
    events,
    messages,
    millis,
    parsed,
    stored,
    table,
)

queries = Registry()

_PARSED = """SELECT event_id AS "offset",
  CASE WHEN event_id % 101 = 0 THEN 'unparsed' ELSE op END AS event_type,
  ms AS event_ms,
  CASE WHEN event_id % 101 = 0 OR user_id = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
  'eventdb' AS service_name,
  CASE WHEN event_id % 101 = 0 THEN 'UPDATE' ELSE operation END AS operation
FROM m"""


@queries.add("parse_event_fields", CDC + _PARSED)
def parse_event_fields(spark, sf):
    """Type, time, user, service and operation of every message that has a value."""
    return parsed(spark, sf).select(
        "offset", "event_type", millis("event_time", "event_ms"), "user_id", "service_name", "operation"
    )


@queries.add("envelope_unwrap", CDC + _PARSED)
def envelope_unwrap(spark, sf):
    """The same fields from documents nested in a payload."""
    return parsed(spark, sf, nested=True).select(
        "offset", "event_type", millis("event_time", "event_ms"), "user_id", "service_name", "operation"
    )


@queries.add(
    "operation_map",
    CDC + "SELECT op, operation, count(*) AS n FROM g GROUP BY op, operation",
)
def operation_map(spark, sf):
    return (
        ingest.filter_event_types(parsed(spark, sf))
        .groupBy(F.col("event_type").alias("op"), "operation")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@queries.add(
    "source_coordinates",
    CDC
    + """SELECT event_id AS "offset", 'eventdb' AS source_service, 'analytics' AS database_name,
  'public' AS namespace_name, event_type AS raw_table, 'public.' || event_type AS table_name,
  event_type || '|public.' || event_type || '|analytics.' || event_type || '|analytics.public.' || event_type AS names
FROM g""",
)
def source_coordinates(spark, sf):
    database, namespace, bare = (F.col(f"source_{n}") for n in ("database", "namespace", "table"))
    return ingest.filter_event_types(parsed(spark, sf)).select(
        "offset",
        "source_service",
        database.alias("database_name"),
        namespace.alias("namespace_name"),
        bare.alias("raw_table"),
        "table_name",
        F.array_join(origin.filter_names(database, namespace, bare), "|").alias("names"),
    )


@queries.add(
    "canonical_service",
    """WITH t AS (SELECT event_id,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '.public' END AS topic,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'svc' || user_id % 5 END AS parsed FROM events)
SELECT event_id, coalesce(nullif(split_part(topic, '.', 1), ''), parsed, 'unknown') AS service FROM t""",
)
def canonical_service(spark, sf):
    topic = F.expr("CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(event_type, '.public') END")
    name = F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('svc', user_id % 5) END")
    return events(spark, sf).select(
        "event_id", parsing.canonical_service(topic, name).alias("service")
    )


@queries.add(
    "time_precedence",
    """SELECT event_id, CASE event_id % 5
    WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000
    WHEN 2 THEN epoch_us(ts) // 1000000 * 1000 WHEN 3 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000 END AS event_ms
FROM events""",
)
def time_precedence(spark, sf):
    """Milliseconds in the payload, ISO text, seconds, a later alternative, record time."""
    doc = F.expr(
        """CASE event_id % 5
        WHEN 0 THEN concat('{"payload":{"ts_ms":', unix_millis(ts), '},"event_time":"1999-01-01T00:00:00Z"}')
        WHEN 1 THEN concat('{"event_time":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"}')
        WHEN 2 THEN concat('{"event_time":', unix_seconds(ts), '}')
        WHEN 3 THEN concat('{"event_time":"soon","ts_ms":0,"timestamp_ms":', unix_millis(ts), '}')
        ELSE '{"ts":"later"}' END"""
    )
    landed = events(spark, sf).select(
        F.lit("plain").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        doc.alias("value"),
    )
    return ingest.parse_messages(landed).select(
        F.col("offset").alias("event_id"), millis("event_time", "event_ms")
    )


@queries.add(
    "iso_times",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
  WHEN 1 THEN epoch_us(ts) // 1000000 * 1000 - 18000000
  WHEN 2 THEN epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP))
  ELSE epoch_us(ts) // 1000000 * 1000 END AS ms FROM events""",
)
def iso_times(spark, sf):
    """Zulu, offset, date only, and text that is no time."""
    text = F.expr(
        """CASE event_id % 4
        WHEN 0 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')
        WHEN 1 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+05:00')
        WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') ELSE concat('at ', event_id) END"""
    )
    return (
        events(spark, sf)
        .select("event_id", parsing.iso_timestamp(text).alias("t"))
        .select("event_id", millis("t", "ms"))
    )


@queries.add(
    "broker_location",
    CDC
    + """SELECT 'kafka' AS broker_kind, topic AS broker_destination, CAST(part AS VARCHAR) AS broker_substream,
  CAST(event_id AS VARCHAR) AS broker_position, topic AS back_topic, part AS back_partition, event_id AS back_offset
FROM c
UNION ALL
SELECT 'rabbitmq', topic, NULL, CAST(event_id AS VARCHAR), topic, 0, event_id FROM c""",
)
def broker_location(spark, sf):
    """Positions in broker-neutral form, and back again."""
    def there_and_back(kind):
        place = origin.broker_location(kind, F.col("topic"), F.col("partition"), F.col("offset"))
        rows = messages(spark, sf).select(place.alias("p")).select("p.*")
        return rows.withColumn("back", origin.message_position()).select(
            "broker_kind",
            "broker_destination",
            origin.shown_substream(F.col("broker_substream")).alias("broker_substream"),
            "broker_position",
            F.col("back.topic").alias("back_topic"),
            F.col("back.partition").alias("back_partition"),
            F.col("back.offset").alias("back_offset"),
        )

    return there_and_back("kafka").unionByName(there_and_back("rabbitmq"))


@queries.add(
    "tenants_and_sources",
    CDC
    + """SELECT 't' || (user_id % 3) AS tenant_id, 'eventdb' AS quota_source, count(*) AS n FROM g GROUP BY 1, 2""",
)
def tenants_and_sources(spark, sf):
    return (
        ingest.filter_event_types(parsed(spark, sf))
        .select(
            "tenant_id",
            parsing.quota_source(F.lit(""), F.col("source_service"), F.col("topic")).alias(
                "quota_source"
            ),
        )
        .groupBy("tenant_id", "quota_source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@queries.add("tombstone_skip", CDC + "SELECT count(*) AS n, sum(event_id) AS offsets FROM m")
def tombstone_skip(spark, sf):
    return ingest.skip_tombstones(messages(spark, sf)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets")
    )


@queries.add(
    "filter_event_types",
    CDC + """SELECT event_id AS "offset", op AS event_type FROM g WHERE op IN ('c', 'u')""",
)
def filter_event_types(spark, sf):
    return ingest.filter_event_types(parsed(spark, sf), allowed=("c", "u", "d"), ignored=("unparsed", "d")).select(
        "offset", "event_type"
    )


@queries.add(
    "filter_tables",
    CDC
    + """SELECT event_id AS "offset", 'public.' || event_type AS table_name FROM g
WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT event_id, NULL FROM m WHERE event_id % 101 = 0""",
)
def filter_tables(spark, sf):
    """Allowed by three kinds of name, denied by a fourth; no source passes."""
    return ingest.filter_tables(
        parsed(spark, sf),
        allowed=("click", "public.view", "analytics.purchase"),
        ignored=("analytics.public.view",),
    ).select("offset", "table_name")


@queries.add(
    "required_fields",
    """SELECT event_id AS "offset" FROM events WHERE event_id % 3 <> 0""",
)
def required_fields(spark, sf):
    """A key whose value is null counts as present."""
    doc = F.expr(
        """CASE event_id % 3 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"a":1,"b":null}' ELSE '{"b":2,"a":0}' END"""
    )
    landed = events(spark, sf).select(
        F.lit("plain").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"), doc.alias("value"),
    )
    return ingest.require_fields(ingest.parse_messages(landed), ("a", "b")).select("offset")


@queries.add(
    "mask_fields",
    CDC
    + """SELECT event_id AS "offset", '{"items":[{"keep":' || k || ',"token":"***MASKED***"}],"password":"***MASKED***"}' AS meta
FROM g""",
)
def mask_fields(spark, sf):
    masked = ingest.mask_fields(ingest.filter_event_types(parsed(spark, sf)))
    return masked.select("offset", values.json(F.col("event_data"), "meta").alias("meta"))


@queries.add(
    "row_identity",
    CDC + """SELECT event_id AS "offset", '{"id":' || id_json || '}' AS row_identity FROM g""",
)
def row_identity(spark, sf):
    return stored(spark, sf).select("offset", "row_identity")


@queries.add(
    "row_identity_by_name",
    """SELECT l_orderkey, l_linenumber,
  '{"line_id":' || l_linenumber || ',"order_id":' || l_orderkey ||
  CASE WHEN l_returnflag = 'A' THEN '' ELSE ',"paidBy":"' || l_returnflag || '"' END ||
  ',"sku":' || l_partkey || '}' AS row_identity
FROM lineitem""",
)
def row_identity_by_name(spark, sf):
    """Declared key, ``*_id`` names and any name with id; null values drop out."""
    doc = F.to_json(
        F.struct(
            F.struct(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_id"),
                F.col("l_partkey").alias("sku"),
                F.expr("CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END").alias("paidBy"),
                F.col("l_quantity").alias("quantity"),
            ).alias("after")
        ),
        {"ignoreNullFields": "false"},
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        values.parse_json(doc).alias("event_data"),
        F.array(F.lit("sku"), F.lit("absent")).alias("keys"),
    )
    return ingest.with_row_identity(rows, "keys").select("l_orderkey", "l_linenumber", "row_identity")


@queries.add(
    "legacy_backfill",
    """SELECT doc_id AS "offset", 'legacy' AS service_name, 'note' AS event_type, lang AS user_id
FROM documents WHERE doc_id % 3 <> 0""",
)
def legacy_backfill(spark, sf):
    """Raw (id, value) rows parsed, without the ids already stored."""
    docs = table(spark, sf, "documents")
    raw = docs.select(
        F.col("doc_id").alias("id"),
        F.to_json(F.struct(F.lit("note").alias("type"), F.col("lang").alias("user"), "text")).alias("value"),
    )
    known = docs.where("doc_id % 3 = 0").select(
        F.lit("legacy").alias("topic"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset")
    )
    return files.backfill_legacy(raw, known).select("offset", "service_name", "event_type", "user_id")


@queries.add(
    "queue_messages",
    """SELECT role AS topic, 0 AS "partition", conv_id * 1000 + turn AS "offset", 'unparsed' AS event_type
FROM conversations WHERE text IS NOT NULL""",
)
def queue_messages(spark, sf):
    """Queue bodies that are plain text: normalised, then kept as unparsed."""
    rows = table(spark, sf, "conversations").select(
        F.col("role").alias("queue"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("delivery_tag"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.concat(F.lit("text: "), "text").alias("body"),
    )
    return ingest.parse_messages(ingest.skip_tombstones(files.queue_messages(rows))).select(
        "topic", "partition", "offset", "event_type"
    )


def _manifests(spark, sf):
    """One manifest per region; every nation is a connector."""
    nations = table(spark, sf, "nation")
    entry = F.struct(
        F.lower(F.translate("n_name", " ", "_")).alias("source_name"),
        F.expr("CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE concat('db', n_nationkey) END").alias("database_hostname"),
        F.expr(
            "CASE WHEN n_nationkey % 4 = 3 THEN array('public.orders', 'orders') "
            "ELSE array('public.orders', 'public.items') END"
        ).alias("tables"),
        F.expr("n_nationkey % 5 <> 4").alias("enabled"),
    )
    per_region = nations.groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("c")))).alias("cs")
    )
    doc = F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("connectors")))
    return per_region.select(
        F.col("n_regionkey").cast("string").alias("path"), values.parse_json(doc).alias("manifest")
    )


@queries.add(
    "manifest_topics",
    """SELECT DISTINCT lower(replace(n_name, ' ', '_')) || '.' || t AS topic
FROM nation, LATERAL (SELECT unnest(CASE WHEN n_nationkey % 4 = 3 THEN ['public.orders', 'orders']
  ELSE ['public.orders', 'public.items'] END) AS t)
WHERE n_nationkey % 5 <> 4""",
)
def manifest_topics(spark, sf):
    return manifest.subscribed_topics(manifest.connectors(_manifests(spark, sf)))


@queries.add(
    "manifest_violations",
    """WITH n AS (SELECT n_nationkey, n_regionkey,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS path,
  'connectors[' || i || '].database_hostname must be a non-empty string' AS violation
FROM n WHERE n_nationkey % 6 = 5
UNION ALL
SELECT CAST(n_regionkey AS VARCHAR),
  'connectors[' || i || '].tables[1] must match ^[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_-]+$'
FROM n WHERE n_nationkey % 4 = 3""",
)
def manifest_violations(spark, sf):
    return manifest.violations(manifest.connectors(_manifests(spark, sf))).select("path", "violation")
