"""From broker messages to event rows: parse, filter, transform, mask."""

from __future__ import annotations

import pkgutil
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.functions import deep, identity, origin, parsing
from changetide.functions import values as V

Processor = Callable[[DataFrame], DataFrame | None]


def skip_tombstones(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("value").isNotNull())


def parse_messages(messages: DataFrame) -> DataFrame:
    """One event row per message; ``error`` names what makes a message unprocessable.

    Input columns: topic, partition, offset, timestamp, value (binary or text).
    """
    raw = F.col("value").cast("string")
    decoded = messages.select(
        *messages.columns,
        F.make_valid_utf8(raw).alias("raw_payload"),
        F.is_valid_utf8(raw).alias("_readable"),
    )
    documents = V.computed(decoded, _json=V.parse_json(F.col("raw_payload")))
    json = F.col("_json")
    # NULL unless the JSON is an object, so that "is an object" needs no further look.
    read = V.computed(documents, _doc=F.try_variant_get(json, "$", parsing.DOCUMENT))
    read, doc = V.members(read, "_doc", parsing.DOCUMENT)
    extracted = V.computed(
        read,
        _body=F.try_variant_get(doc["payload"], "$", parsing.PAYLOAD),
        _source=F.coalesce(
            F.try_variant_get(doc["source"], "$", parsing.SOURCE),
            F.try_variant_get(V.rare_member(doc["payload"], "source"), "$", parsing.SOURCE),
        ),
    )
    extracted, body = V.members(extracted, "_body", parsing.PAYLOAD)
    extracted, source = V.members(extracted, "_source", parsing.SOURCE)
    is_object = F.col("_doc_found")
    wrapped = F.to_variant_object(F.struct(json.alias("data")))
    op, iso, seconds = F.col("_op"), F.col("_iso"), F.col("_seconds")
    # Several short steps: one long one would exceed what the JVM compiles to machine code.
    origins = V.computed(
        extracted,
        parsed_service=parsing.service_name(json, doc, source),
        **origin.coordinates(source),
    )
    times = V.computed(
        origins,
        _op=parsing.operation_code(json, doc, body),
        _explicit=parsing.explicit_time(doc, body),
        _stamp=parsing.time_stamp(doc),
        tenant_id=parsing.tenant_id(doc, body),
    )
    fields = V.computed(
        times,
        event_type=F.when(json.isNull(), parsing.UNPARSED).otherwise(parsing.event_type(json, doc, op)),
        user_id=parsing.user_id(json, doc),
        _iso=parsing.iso_part(F.col("_explicit")),
        _seconds=parsing.epoch_part(F.col("_explicit"), F.col("_stamp")),
    ).withColumns(
        {
            "operation": parsing.operation(op),
            "event_time": parsing.event_time(iso, seconds, F.col("timestamp")),
            "error": F.when(~F.col("_readable"), F.lit("invalid UTF-8")).otherwise(
                parsing.time_error(iso, seconds)
            ),
        }
    )
    namespace, bare = F.col("source_namespace"), F.col("source_table")
    kept = [c for c in messages.columns if c != "value"]
    return fields.select(
        *kept,
        "event_type",
        "event_time",
        "user_id",
        "parsed_service",
        parsing.canonical_service(F.col("topic"), F.col("parsed_service")).alias("service_name"),
        "operation",
        "tenant_id",
        "source_service",
        "source_database",
        "source_namespace",
        "source_table",
        origin.catalog_service(F.col("topic"), F.col("source_service")).alias("catalog_service"),
        F.coalesce("source_database", F.lit("unknown")).alias("database_name"),
        origin.qualified_table(namespace, bare).alias("table_name"),
        F.when(is_object, json).when(json.isNotNull(), wrapped).alias("event_data"),
        "raw_payload",
        F.col("event_time").alias("capture_time"),
        "error",
    ).withColumn(
        "table_id",
        origin.table_id(F.col("catalog_service"), F.col("database_name"), F.col("table_name")),
    )


def fallback_event(messages: DataFrame) -> DataFrame:
    """Stand-in event for a message that cannot be processed at all."""
    return messages.select(
        "topic",
        "partition",
        "offset",
        F.lit(parsing.UNPARSED).alias("event_type"),
        F.col("timestamp").alias("event_time"),
        parsing.canonical_service(F.col("topic"), F.lit(None).cast("string")).alias("service_name"),
        F.lit("UNKNOWN").alias("operation"),
        F.make_valid_utf8(F.col("value").cast("string")).alias("raw_payload"),
    )


def envelope_rows(events: DataFrame, unwrap_envelope: bool = True) -> DataFrame:
    """Add ``after_row`` and ``before_row`` as key → VARIANT maps.

    ``unwrap_envelope=False`` looks at the top level only.
    """
    envelope = parsing.unwrap(F.col("event_data")) if unwrap_envelope else F.col("event_data")
    return (
        events.withColumn("_envelope", envelope)
        .withColumns(
            {
                "after_row": V.as_row(F.col("_envelope"), "after"),
                "before_row": V.as_row(F.col("_envelope"), "before"),
            }
        )
        .drop("_envelope")
    )


def with_row_identity(events: DataFrame, key_columns: str | None = None) -> DataFrame:
    """Add ``row_identity``; ``key_columns`` names an array column of declared keys."""
    declared = F.col(key_columns) if key_columns else None
    return (
        envelope_rows(events)
        .withColumn("row_identity", identity.row_identity(F.col("after_row"), F.col("before_row"), declared))
        .drop("after_row", "before_row")
    )


def type_passes(allowed: Sequence[str] = (), ignored: Sequence[str] = (parsing.UNPARSED,)) -> Column:
    """Allow and deny lists of event types; events without a type always pass."""
    kind = F.col("event_type")
    passes = F.lit(True)
    if allowed:
        passes = passes & kind.isin(*allowed)
    if ignored:
        passes = passes & ~kind.isin(*ignored)
    return kind.isNull() | (kind == "") | passes


def table_passes(allowed: Sequence[str] = (), ignored: Sequence[str] = ()) -> Column:
    """Allow and deny lists over every name a table goes by; no source passes."""
    if not allowed and not ignored:
        return F.lit(True)
    names = origin.filter_names(
        F.col("source_database"), F.col("source_namespace"), F.col("source_table")
    )
    passes = F.lit(True)
    if allowed:
        passes = passes & F.arrays_overlap(names, F.array(*map(F.lit, allowed)))
    if ignored:
        passes = passes & ~F.arrays_overlap(names, F.array(*map(F.lit, ignored)))
    return F.col("source_table").isNull() | passes


def fields_pass(required: Sequence[str] = ()) -> Column:
    """Documents with every listed top-level key, null included."""
    if not required:
        return F.lit(True)
    keys = F.map_keys(F.try_variant_get(F.col("event_data"), "$", V.ROW_TYPE))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    return F.coalesce(F.size(missing) == 0, F.lit(False)) & keys.isNotNull()


def filter_event_types(
    events: DataFrame, allowed: Sequence[str] = (), ignored: Sequence[str] = (parsing.UNPARSED,)
) -> DataFrame:
    return events.where(type_passes(allowed, ignored))


def filter_tables(
    events: DataFrame, allowed: Sequence[str] = (), ignored: Sequence[str] = ()
) -> DataFrame:
    return events.where(table_passes(allowed, ignored))


def require_fields(events: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    return events.where(fields_pass(required))


def load_processor(reference: str) -> Processor:
    """Resolve ``module:function`` or ``module.function``."""
    try:
        found = pkgutil.resolve_name(reference)
    except (ImportError, AttributeError, ValueError) as exc:
        raise ValueError(f"no processor under the name {reference!r}") from exc
    if not callable(found):
        raise ValueError(f"{reference!r} names something that is no processor")
    return found


def apply_processors(events: DataFrame, processors: Iterable[Processor | str] = ()) -> DataFrame:
    """Run frame-level processors in order; returning None keeps the frame as it was."""
    for processor in processors:
        step = load_processor(processor) if isinstance(processor, str) else processor
        changed = step(events)
        events = events if changed is None else changed
    return events


def mask_fields(
    events: DataFrame,
    names: Sequence[str] = deep.DEFAULT_MASKED,
    mask_raw: bool = False,
    as_received: bool = False,
) -> DataFrame:
    """Mask the listed keys at any depth of ``event_data``.

    ``raw_payload`` is what text search reads; it stays as received unless ``mask_raw``. With
    ``as_received``, ``event_data`` is known to be what ``raw_payload`` says, and documents whose text
    holds no such key are neither printed nor parsed again.
    """
    if not names:
        return events
    document = F.to_json("event_data")
    if as_received:
        document = F.when(deep.names_any(F.col("raw_payload"), names), document)
    # Printed once: masking looks at the text many times.
    printed = V.computed(events, _text=document)
    masked = printed.withColumn("_masked", deep.mask_json(F.col("_text"), names, compact=True)).drop("_text")
    again = F.when(F.col("_masked").isNotNull(), V.parse_json(F.col("_masked"))).otherwise(F.col("_kept"))
    out = V.computed(masked.withColumnRenamed("event_data", "_kept"), event_data=again).drop("_kept")
    if mask_raw:
        out = out.withColumn("raw_payload", F.coalesce("_masked", "raw_payload"))
    return out.drop("_masked")


def prepare_events(
    messages: DataFrame,
    *,
    allowed_types: Sequence[str] = (),
    ignored_types: Sequence[str] = (parsing.UNPARSED,),
    allowed_tables: Sequence[str] = (),
    ignored_tables: Sequence[str] = (),
    required: Sequence[str] = (),
    processors: Iterable[Processor | str] = (),
    masked: Sequence[str] = deep.DEFAULT_MASKED,
    mask_raw: bool = False,
) -> DataFrame:
    """Messages to filtered, processed and masked events.

    Rows with an ``error`` are for the dead letters and pass every filter.
    """
    events = parse_messages(skip_tombstones(messages))
    passes = (
        type_passes(allowed_types, ignored_types)
        & table_passes(allowed_tables, ignored_tables)
        & fields_pass(required)
    )
    events = events.where(F.col("error").isNotNull() | passes)
    processors = list(processors)
    events = apply_processors(events, processors)
    return mask_fields(events, masked, mask_raw, as_received=not processors)
