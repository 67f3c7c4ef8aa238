"""Event fields from a parsed payload: type, time, user, service, operation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetide.functions import values as V

# Epoch numbers above this are milliseconds, and years 1 to 9999 are valid.
MILLIS_ABOVE = 10_000_000_000
MIN_SECONDS = -62_135_596_800
MAX_SECONDS = 253_402_300_799

Members = Mapping[str, Column]

UNKNOWN = "unknown"
UNPARSED = "unparsed"

_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}.*)?$"
_NUMBER = r"^-?[0-9]"


# Members read from the document, its payload and its source, each in one extraction.
_BODY = "op:string,ts_ms:variant,tenant_id:string,tenant:string,tenantId:string"
DOCUMENT = (
    f"struct<{_BODY},event_type:string,type:string,event_time:variant,timestamp_ms:variant,ts:variant,"
    "user_id:string,userId:string,user:string,service_name:string,service:string,payload:variant,source:variant>"
)
PAYLOAD = f"struct<{_BODY}>"
SOURCE = (
    "struct<name:string,server:string,db:string,database:string,catalog:string,schema:string,"
    "schema_name:string,table:string,collection:string>"
)


def payload_of(data: Column) -> Column:
    """Nested ``payload`` object, NULL when there is none."""
    payload = V.rare_member(data, "payload")
    return F.when(V.is_object(payload), payload)


def unwrap(data: Column) -> Column:
    """The change envelope: nested ``payload`` object, else the document itself."""
    return F.coalesce(payload_of(data), data)


def iso_timestamp(value: Column) -> Column:
    """ISO-8601 text to timestamp; no zone means UTC, anything else gives NULL."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(_ISO), F.try_to_timestamp(trimmed))


def epoch_seconds(number: Column) -> Column:
    """Epoch number in seconds or milliseconds, as (fractional) seconds."""
    x = number.try_cast("double")
    return F.when(x > MILLIS_ABOVE, x / 1000.0).otherwise(x)


def seconds_timestamp(seconds: Column) -> Column:
    """Epoch seconds to timestamp; NULL outside years 1 to 9999."""
    inside = seconds.between(MIN_SECONDS, MAX_SECONDS)
    return F.when(inside, F.timestamp_micros(F.round(seconds * 1_000_000.0).try_cast("bigint")))


def explicit_time(doc: Members, body: Members) -> Column:
    """Canonical JSON of the explicit time: payload stamp, else ``event_time``."""
    return F.coalesce(V.nonempty(F.to_json(body["ts_ms"])), F.to_json(doc["event_time"]))


def time_stamp(doc: Members) -> Column:
    """Canonical JSON of the stamp used when the explicit time is missing or unreadable."""
    return F.coalesce(*(V.nonempty(F.to_json(doc[n])) for n in ("ts_ms", "timestamp_ms", "ts")))


def iso_part(explicit: Column) -> Column:
    """ISO time, which only a JSON string can hold."""
    return F.when(explicit.startswith('"'), iso_timestamp(F.trim(explicit, F.lit('"'))))


def epoch_part(explicit: Column, stamp: Column) -> Column:
    """Epoch seconds, which only a JSON number can hold."""
    return F.coalesce(
        F.when(explicit.rlike(_NUMBER), epoch_seconds(explicit)),
        F.when(stamp.rlike(_NUMBER), epoch_seconds(stamp)),
    )


def event_time(iso: Column, seconds: Column, arrival: Column) -> Column:
    """Stated time, else the broker's record time (deterministic on redelivery)."""
    return F.coalesce(iso, seconds_timestamp(seconds), arrival)


def time_error(iso: Column, seconds: Column) -> Column:
    """Message for an epoch number outside years 1 to 9999, else NULL."""
    outside = iso.isNull() & ~seconds.between(MIN_SECONDS, MAX_SECONDS)
    return F.when(outside, F.lit("event time out of range"))


def event_type(json: Column, doc: Members, op: Column) -> Column:
    return F.coalesce(
        V.given(doc["event_type"], json, "$.event_type"),
        V.given(doc["type"], json, "$.type"),
        op,
        F.lit(UNKNOWN),
    )


def operation_code(json: Column, doc: Members, body: Members) -> Column:
    return F.coalesce(V.given(doc["op"], json, "$.op"), V.given(body["op"], json, "$.payload.op"))


def user_id(json: Column, doc: Members) -> Column:
    return F.coalesce(
        V.given(doc["user_id"], json, "$.user_id"), V.given(doc["userId"], json, "$.userId"), doc["user"]
    )


def source_service(source: Members) -> Column:
    return V.first_filled(source["name"], source["server"])


def service_name(json: Column, doc: Members, source: Members) -> Column:
    return F.coalesce(
        V.given(doc["service_name"], json, "$.service_name"), doc["service"], source_service(source)
    )


def operation(code: Column) -> Column:
    """INSERT, UPDATE or DELETE; anything unrecognised is an UPDATE."""
    return F.when(code.isin("c", "r"), "INSERT").when(code == "d", "DELETE").otherwise("UPDATE")


def canonical_service(topic: Column, parsed: Column) -> Column:
    """Topic prefix, else the parsed name, else ``unknown``."""
    return F.coalesce(
        F.nullif(F.substring_index(topic, ".", 1), F.lit("")),
        F.nullif(parsed, F.lit("")),
        F.lit(UNKNOWN),
    )


def tenant_id(doc: Members, body: Members) -> Column:
    names = ("tenant_id", "tenant", "tenantId")
    return V.first_filled(*(part[n] for part in (doc, body) for n in names))


def quota_source(service: Column, source_name: Column, topic: Column) -> Column:
    return F.coalesce(
        F.nullif(service, F.lit("")),
        source_name,
        F.nullif(topic, F.lit("")),
        F.lit(UNKNOWN),
    )
