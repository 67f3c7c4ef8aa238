"""Fixed schemas of the stored tables and of the broker message."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
    VariantType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "boolean": BooleanType(),
    "binary": BinaryType(),
    "timestamp": TimestampType(),
    "variant": VariantType(),
}


def _columns(text: str) -> StructType:
    """Schema from "name type, …"; unlike the DDL reader it needs no running session."""
    schema = StructType()
    for column in text.split(","):
        name, kind = column.split()
        schema = schema.add(name, _TYPES[kind])
    return schema


MESSAGE = _columns(
    "topic string, partition int, offset bigint, timestamp timestamp, value binary"
)

LANDED_MESSAGE = _columns(
    "topic string, partition int, offset bigint, timestamp timestamp, value string"
)

QUEUE_MESSAGE = _columns(
    "queue string, delivery_tag bigint, timestamp timestamp, body string"
)

POSITION_RUNS = _columns(
    "topic string, partition int, span bigint, first_offset bigint, last_offset bigint"
)

EVENTS = _columns(
    """topic string, partition int, offset bigint, event_type string, event_time timestamp,
    user_id string, service_name string, table_id bigint, operation string, row_identity string,
    event_data variant, raw_payload string, capture_time timestamp, ingested_at timestamp"""
)

COLUMN_CHANGES = _columns(
    """topic string, partition int, offset bigint, table_id bigint, column_id bigint,
    column_name string, operation string, row_identity string, old_value string,
    new_value string, changed_at timestamp"""
)

MONITORED_TABLES = _columns(
    """table_id bigint, service_name string, database_name string, table_name string,
    topic_name string, is_active boolean"""
)

MONITORED_COLUMNS = _columns(
    """table_id bigint, column_id bigint, column_name string, data_type string,
    is_primary_key boolean, is_nullable boolean, audit_enabled boolean"""
)

DEAD_LETTERS = _columns(
    """service_name string, broker_kind string, broker_destination string,
    broker_substream string, broker_position string, kafka_topic string, kafka_partition int,
    kafka_offset bigint, operation string, raw_payload string, error_message string,
    failed_at timestamp, is_replayed boolean, replayed_at timestamp, replay_error string"""
)

CHECKPOINTS = _columns(
    """consumer_group string, broker_kind string, broker_destination string,
    broker_substream string, broker_position string, kafka_topic string, kafka_partition int,
    kafka_offset bigint, last_event_time timestamp"""
)

QUOTA_WINDOWS = _columns(
    "dimension string, identity string, window_start timestamp, event_count bigint"
)

AUDIT_LOG = _columns(
    """api_key_id bigint, endpoint string, method string, status_code int, ip_address string,
    timestamp timestamp"""
)

AUDIT_SPILL = _columns(
    """id bigint, entry string, error_message string, spilled_at timestamp, replayed boolean,
    replayed_by string, replayed_at timestamp"""
)

LEGACY_EVENTS = _columns("id bigint, value string")

INGESTION_COUNTERS = _columns(
    "service_name string, consumed bigint, processed bigint, duplicate bigint, failed bigint"
)

BATCHES = _columns("state string, seq bigint, folded string, upto bigint")

# Keys
POSITION = ("topic", "partition", "offset")
# Order of events with equal time: numeric first, so that ties can be cut into ranges.
POSITION_ORDER = ("offset", "partition", "topic")
TABLE_KEY = ("service_name", "database_name", "table_name")
DEAD_LETTER_KEY = ("broker_kind", "broker_destination", "broker_substream", "broker_position")
CHECKPOINT_KEY = ("consumer_group", "broker_kind", "broker_destination", "broker_substream")
