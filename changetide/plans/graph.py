"""Messages to the whole event graph: events, catalog, column changes, dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from changetide import schemas
from changetide.operators import catalog, changes, deadletter, dedupe, ingest


@dataclass(frozen=True)
class EventGraph:
    """``tables`` and ``columns`` hold the catalog entries the batch describes, already merged."""

    events: DataFrame
    tables: DataFrame
    columns: DataFrame
    changes: DataFrame
    dead_letters: DataFrame


def event_graph(
    messages: DataFrame,
    failed_at: Column,
    *,
    stored: DataFrame | None = None,
    known_tables: DataFrame | None = None,
    known_columns: DataFrame | None = None,
    on_error: str = "dlq",
    **pipeline,
) -> EventGraph:
    """Build every output of a batch of messages; nothing is run yet."""
    return graph_of(
        ingest.prepare_events(messages, **pipeline),
        failed_at,
        stored=stored,
        known_tables=known_tables,
        known_columns=known_columns,
        on_error=on_error,
    )


def graph_of(
    prepared: DataFrame,
    failed_at: Column,
    *,
    stored: DataFrame | None = None,
    known_tables: DataFrame | None = None,
    known_columns: DataFrame | None = None,
    on_error: str = "dlq",
) -> EventGraph:
    """The graph of already prepared events (which a caller may have persisted)."""
    good, bad = deadletter.split_errors(prepared, on_error)
    tables = catalog_tables(good, known_tables)
    described, audited = catalog_columns(good, known_columns)
    events = identified_events(good, audited, stored)
    return EventGraph(
        events=events,
        tables=tables,
        columns=described,
        changes=audited_changes(events, audited),
        dead_letters=deadletter.dead_letters(bad, failed_at),
    )


def catalog_tables(good: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Catalog entries of the tables a batch touches."""
    tables = catalog.discover_tables(good)
    if known is None:
        return tables
    return catalog.upsert_tables(known, tables, touched_only=True)


def catalog_columns(
    good: DataFrame, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Catalog entries of the columns a batch describes, and all columns there are then.

    Either one reads the events once."""
    described = catalog.discover_columns(good)
    if known is None:
        return described, described
    return catalog.upsert_columns(known, described, touched_only=True), catalog.upsert_columns(known, described)


def identified_events(
    good: DataFrame, columns: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Events whose position is new, with their row identity."""
    fresh = (
        dedupe.distinct_positions(good) if stored is None else dedupe.new_positions(good, stored)
    )
    keyed = catalog.attach_key_columns(fresh, columns)
    return ingest.with_row_identity(keyed, "key_columns").drop("key_columns")


def audited_changes(events: DataFrame, columns: DataFrame) -> DataFrame:
    return changes.column_changes(events, columns).select(*schemas.COLUMN_CHANGES.names)


def stored_events(events: DataFrame, ingested_at: Column) -> DataFrame:
    """Events in the layout of the stored table."""
    return events.withColumn("ingested_at", ingested_at).select(*schemas.EVENTS.names)
