"""Streaming ingestion: at-least-once reading, exactly-once storing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from changetide.operators import deadletter, feed, health, ingest, quota, runs
from changetide.plans import graph
from changetide.schemas import POSITION
from changetide.streaming import progress, tables


def distinct_messages(messages: DataFrame, horizon: str) -> DataFrame:
    """Drop redelivered positions within a horizon of record time; state stays bounded."""
    return messages.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(list(POSITION))


def store_batch(
    root: str, *, on_error: str = "dlq", now: Callable[[], Column] = F.current_timestamp, **pipeline
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the event graph of each micro-batch.

    All outputs of a batch become visible together, after the last is written. A repeated batch
    replaces its own output. A position that another batch has stored is left out, whatever its
    time; a message that neither states a time nor has a record time gets the time of its storing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        _store(batch, batch_id, root, on_error, now(), pipeline)

    return store


def _timed(events: DataFrame, moment: datetime) -> DataFrame:
    """Rows without any time happened, as far as is known, at the moment they are stored."""
    return events.withColumns({c: F.coalesce(c, F.lit(moment)) for c in ("event_time", "capture_time")})


def _store(
    messages: DataFrame, batch_id: int, root: str, on_error: str, now: Column, pipeline: Mapping
) -> None:
    spark = messages.sparkSession
    if not tables.begin(spark, root, batch_id):
        return
    moment = spark.range(1).select(now).head()[0]
    # Written once: what follows neither parses again nor plans through the parse.
    parsed = _timed(ingest.prepare_events(messages, **pipeline), moment)
    prepared = _settled(parsed, f"{root}/_staging/batch")
    good, bad = deadletter.split_errors(prepared, on_error)
    fresh = runs.new_positions(good, tables.known_positions(spark, root, prepared))
    letters = deadletter.dead_letters(bad, F.lit(moment))
    stored = _write_graph(spark, root, batch_id, good, fresh, letters, moment)
    tables.write_batch(health.outcome_counters(prepared, stored), root, "ingestion_counters", batch_id)
    tables.publish(spark, root, batch_id)


def _settled(frame: DataFrame, path: str) -> DataFrame:
    """What was computed stays as it is while the tables it was read from grow."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _write_graph(
    spark: SparkSession, root: str, batch_id: int, good: DataFrame, fresh: DataFrame, letters: DataFrame, moment: datetime
) -> DataFrame:
    """Write catalog entries, dead letters, changes, events and positions of a batch; returns the events as written."""
    described, _ = graph.catalog_columns(good, tables.current_columns(spark, root))
    tables.write_batch(graph.catalog_tables(good, tables.current_tables(spark, root)), root, "monitored_tables", batch_id)
    tables.write_batch(described, root, "monitored_columns", batch_id)
    # The catalog as written is small; working it out again would take another pass.
    columns = tables.current_columns(spark, root, also=batch_id)
    events = graph.identified_events(fresh, columns)
    tables.write_batch(graph.stored_events(events, F.lit(moment)), root, "events", batch_id)
    # changes and positions are read off what is stored: they cannot say otherwise, and new positions are
    # searched for once
    stored = tables.written(spark, root, "events", batch_id)
    tables.write_batch(graph.audited_changes(stored, columns), root, "column_changes", batch_id)
    tables.write_batch(runs.runs_of(stored), root, "positions", batch_id)
    tables.write_batch(letters, root, "dead_letter_events", batch_id)
    return stored


def ingest_stream(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    *,
    dedupe_horizon: str | None = None,
    trigger: Mapping[str, object] | None = None,
    services: Sequence[str] = (),
    **options,
) -> DataStreamWriter:
    """Ready-to-start writer; the default trigger drains what is there and stops.

    Each micro-batch reports what it read with its progress (``progress.observed``), split by the
    first part of the topic for the services named."""
    source = progress.observed(messages, services)
    source = distinct_messages(source, dedupe_horizon) if dedupe_horizon else source
    return (
        source.writeStream.foreachBatch(store_batch(root, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )


def replay_dead_letters(
    spark: SparkSession, root: str, run_id: int, now: datetime, limit: int = 100, **pipeline
) -> DataFrame:
    """One replay run over the oldest pending letters; returns the outcome per letter.

    Letters go through the whole path, discovery of tables and columns included. Events and marks
    become visible together, under a negative batch id of the run's own, so a run that broke off can
    be repeated and nothing is marked that isn't stored.
    """
    if run_id < 1:
        raise ValueError("run_id starts at 1")
    batch_id = -run_id
    tables.begin(spark, root, batch_id)

    def settled(frame: DataFrame, name: str) -> DataFrame:
        return _settled(frame, f"{root}/_replays/run_id={run_id}/{name}")

    letters = settled(deadletter.replay_batch(tables.current_dead_letters(spark, root), limit), "letters")
    known = tables.known_positions(spark, root, deadletter.as_messages(letters))
    fresh, outcome = deadletter.replay(letters, known, runs.new_positions, **pipeline)
    fresh, outcome = settled(fresh, "events"), settled(outcome, "outcome")
    marks = deadletter.replay_marks(letters, outcome, F.lit(now))
    _write_graph(spark, root, batch_id, fresh, fresh, marks, now)
    tables.publish(spark, root, batch_id)
    return outcome


def quota_batch(
    root: str, sink: Callable[[DataFrame, int], None], **rules
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies quotas across micro-batches.

    Slots used by earlier batches are carried in, and a hot identity is ranked in slices, which a
    per-key stateful operator could not do. ``sink`` gets the decided batch.
    """
    shape = {k: rules[k] for k in ("arrival", "window_seconds", "source", "tenant") if k in rules}

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = quota.window_start(F.col(rules["arrival"]), rules["window_seconds"])
        first = batch.agg(F.min(start).alias("t")).head().t
        used = tables.used_quota(spark, root, before=batch_id, since=F.lit(first))
        decided = quota.apply_quota(batch, carried=used, **rules).persist()
        try:
            tables.write_batch(
                quota.window_counts(decided, **shape), root, "ingestion_quota_windows", batch_id
            )
            sink(decided, batch_id)
        finally:
            decided.unpersist()

    return decide


def windowed_counts(
    events: DataFrame, width: str, lateness: str, positions: tuple[str, ...] = ()
) -> DataFrame:
    """Counts per event-time window, service, type and operation; late rows are bounded.

    positions: columns by which redelivered rows are left out, within the same lateness."""
    timed = events.withWatermark("event_time", lateness)
    if positions:
        timed = timed.dropDuplicatesWithinWatermark(list(positions))
    return (
        timed
        .groupBy(F.window("event_time", width).alias("w"), "service_name", "event_type", "operation")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "service_name", "event_type", "operation", "n")
    )


def feed_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write the live feed as text files, one message per line."""
    return (
        feed.feed_rows(events)
        .select(F.col("body").alias("value"))
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
