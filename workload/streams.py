"""Streaming runs over landed messages, compared with what a batch gives.

Each query lands the given events as files in a new folder of the shared checkpoint folder, drains
them and reads the result.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from changetide.functions import values
from changetide.operators import changes, deadletter, ingest, ordered, quota, retention
from changetide.schemas import POSITION
from changetide.session import work_folder
from changetide.sources import files
from changetide.streaming import ingestion, progress, tables
from workload.samples import CDC, CHANGES, Registry, events, messages, millis, redelivered

queries = Registry()


def workspace(spark) -> str:
    """A new folder that all machines of the session share."""
    return work_folder(spark)


def land(spark, sf, where: str, parts: int = 5) -> str:
    """Messages as JSON lines, cut by offset into ``parts`` folders and files."""
    rows = redelivered(messages(spark, sf)).withColumn("value", F.col("value").cast("string"))
    path = f"{where}/landed"
    rows.repartition(parts, F.col("offset") % parts).write.json(path)
    return path


def run(writer) -> None:
    query = writer.start()
    query.awaitTermination()


def ingested(spark, sf) -> str:
    """Land and ingest everything; returns the root of the stored tables."""
    where = workspace(spark)
    source = files.read_messages(spark, land(spark, sf, where), stream=True, max_files=3)
    root = f"{where}/tables"
    run(ingestion.ingest_stream(source, root, f"{where}/checkpoint"))
    return root


@queries.add(
    "stream_events",
    CDC
    + """SELECT event_id AS "offset", topic, ms AS event_ms, '{"id":' || id_json || '}' AS row_identity, operation FROM g""",
)
def stream_events(spark, sf):
    """Stored events of a run with redelivered positions: each exactly once."""
    rows = tables.read_log(spark, ingested(spark, sf), "events")
    return rows.select("offset", "topic", millis("event_time", "event_ms"), "row_identity", "operation")


@queries.add(
    "stream_changes",
    CHANGES + """SELECT event_id AS "offset", col AS column_name, old_value, new_value FROM h""",
)
def stream_changes(spark, sf):
    rows = tables.read_log(spark, ingested(spark, sf), "column_changes")
    return rows.select("offset", "column_name", "old_value", "new_value")


@queries.add(
    "stream_catalog",
    CDC
    + """SELECT 'public.' || event_type AS table_name, topic AS topic_name, col AS column_name
FROM (SELECT DISTINCT event_type, topic FROM g), (VALUES ('id'), ('event_type'), ('value'), ('k')) AS t(col)""",
)
def stream_catalog(spark, sf):
    """Catalog after several incremental batches."""
    root = ingested(spark, sf)
    return tables.current_tables(spark, root).join(tables.current_columns(spark, root), "table_id").select(
        "table_name", "topic_name", "column_name"
    )


@queries.add(
    "stream_window_counts",
    CDC
    + """SELECT ms // 3600000 * 3600000 AS window_ms, 'eventdb' AS service_name, op AS event_type, operation, count(*) AS n
FROM g GROUP BY ALL""",
)
def stream_window_counts(spark, sf):
    """Hourly counts kept as streaming state, redelivered positions once; whatever the order of the
    files, no event is later than the span of the table."""
    where = workspace(spark)
    landed = files.read_messages(spark, land(spark, sf, where), stream=True)
    rows = ingest.filter_event_types(ingest.parse_messages(ingest.skip_tombstones(landed)))
    span = events(spark, sf).agg(F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts")) + 1).head()[0] or 1
    counts = ingestion.windowed_counts(rows, "1 hour", f"{span} seconds", POSITION)
    name = f"counts_{uuid.uuid4().hex}"
    run(
        counts.select(F.unix_millis("window_start").alias("window_ms"), "service_name", "event_type", "operation", "n")
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{where}/{name}"))
        .option("checkpointLocation", f"{where}/counts_checkpoint")
        .trigger(availableNow=True)
    )
    final = spark.read.parquet(f"{where}/{name}")
    return final.groupBy("window_ms", "service_name", "event_type", "operation").agg(F.max("n").alias("n"))


@queries.add(
    "stream_current_state",
    CDC
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ms DESC, event_id DESC) AS rn FROM g)
SELECT event_type AS "table", '{"id":' || id_json || '}' AS row_identity, a_k AS k FROM s WHERE rn = 1 AND op <> 'd'""",
)
def stream_current_state(spark, sf):
    """Row state by event order although files arrive newest first."""
    where = workspace(spark)
    spread = messages(spark, sf).withColumn("value", F.col("value").cast("string"))
    spread.repartitionByRange(5, F.col("offset").desc()).write.json(f"{where}/landed")
    source = files.read_messages(spark, f"{where}/landed", stream=True, max_files=1)
    rows = ingest.with_row_identity(
        ingest.filter_event_types(ingest.parse_messages(ingest.skip_tombstones(source)))
    )
    state = changes.current_state(
        rows.withColumn("table_id", F.col("source_table")), keep_deleted=True
    )
    out = f"{where}/state"
    run(
        state.writeStream.outputMode("update")
        .foreachBatch(
            lambda df, i: df.withColumn("batch_id", F.lit(i)).write.mode("append").parquet(out)
        )
        .option("checkpointLocation", f"{where}/state_checkpoint")
        .trigger(availableNow=True)
    )
    image = F.struct("operation", "row")
    latest = spark.read.parquet(out).groupBy("table_id", "row_identity").agg(
        F.max_by(image, "batch_id").alias("i")
    )
    return latest.where("i.operation <> 'DELETE'").select(
        F.col("table_id").alias("table"),
        "row_identity",
        values.json(F.parse_json("i.row"), "k").alias("k"),
    )


@queries.add(
    "stream_quota",
    """WITH a AS (SELECT event_id, user_id % 2 AS src, epoch_us(ts) // 3600000000 AS w, count(*) AS n FROM events GROUP BY ALL)
SELECT 's' || src AS service_name, w * 3600000 AS window_ms, CAST(least(sum(n), 4) AS BIGINT) AS admitted FROM a GROUP BY ALL""",
)
def stream_quota(spark, sf):
    """Slots carried over micro-batches: no window ever admits more than its limit."""
    where = workspace(spark)
    rows = events(spark, sf).select(
        "event_id", "ts", F.expr("concat('s', user_id % 2)").alias("service_name")
    )
    rows.repartition(4, F.col("event_id") % 4).write.parquet(f"{where}/landed")
    source = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/landed")
    )
    out = f"{where}/decided"
    decide = ingestion.quota_batch(
        f"{where}/tables",
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"),
        arrival="ts",
        window_seconds=3600,
        tenant=None,
        source_limit=4,
        ties=("event_id",),
        slicing=ordered.DEFAULT,
    )
    run(
        source.writeStream.foreachBatch(decide)
        .option("checkpointLocation", f"{where}/quota_checkpoint")
        .trigger(availableNow=True)
    )
    start = F.unix_millis(quota.window_start(F.col("ts"), 3600)).alias("window_ms")
    return (
        spark.read.parquet(out).where("allowed").groupBy("service_name", start)
        .agg(F.count(F.lit(1)).alias("admitted"))
    )


@queries.add(
    "stream_feed",
    CDC
    + """SELECT event_id AS "offset", op AS event_type, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') AS at FROM g""",
)
def stream_feed(spark, sf):
    """The live feed as written by a stream."""
    where = workspace(spark)
    messages(spark, sf).withColumn("value", F.col("value").cast("string")).write.json(f"{where}/landed")
    source = files.read_messages(spark, f"{where}/landed", stream=True)
    rows = ingest.with_row_identity(
        ingest.filter_event_types(ingest.parse_messages(ingest.skip_tombstones(source)))
    )
    run(ingestion.feed_stream(rows, f"{where}/feed", f"{where}/feed_checkpoint"))
    body = values.parse_json(F.col("value"))
    return spark.read.text(f"{where}/feed").select(
        F.try_variant_get(body, "$.event.id.offset", "bigint").alias("offset"),
        F.try_variant_get(body, "$.event.event_type", "string").alias("event_type"),
        F.left(F.try_variant_get(body, "$.event.event_time", "string"), F.lit(19)).alias("at"),
    )


def _twice(spark, sf, change):
    """Store messages as one batch, and again, changed, as the next; the root of the tables."""
    root = f"{workspace(spark)}/tables"
    store = ingestion.store_batch(root)
    rows = messages(spark, sf)
    store(rows, 0)
    store(change(rows), 1)
    return root


@queries.add(
    "stream_redelivered_other_month",
    CDC + """SELECT event_id AS "offset", count(*) AS n, max(ms) AS event_ms FROM g GROUP BY event_id""",
)
def stream_redelivered_other_month(spark, sf):
    """A position is stored once, even if it comes again with a time months later."""
    later = lambda m: m.withColumn(
        "value", F.encode(F.regexp_replace(F.decode("value", "UTF-8"), '"ts_ms":([0-9]{3})', '"ts_ms":9$1'), "UTF-8")
    )
    found = tables.read_log(spark, _twice(spark, sf, later), "events")
    return found.groupBy("offset").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.unix_millis("event_time")).alias("event_ms")
    )


@queries.add(
    "stream_without_time",
    CDC + """SELECT event_id AS "offset", count(*) AS n, true AS timed FROM g GROUP BY event_id""",
)
def stream_without_time(spark, sf):
    """Messages without any time get the time of their storing, once."""
    bare = lambda m: m.withColumns(
        {
            "value": F.encode(F.regexp_replace(F.decode("value", "UTF-8"), '"ts_ms":[0-9]+', '"x":0'), "UTF-8"),
            "timestamp": F.lit(None).cast("timestamp"),
        }
    )
    root = f"{workspace(spark)}/tables"
    store = ingestion.store_batch(root)
    for batch_id in range(2):
        store(bare(messages(spark, sf)), batch_id)
    rows = tables.read_log(spark, root, "events")
    return rows.groupBy("offset").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("capture_time").isNotNull() & F.col("month").isNotNull()).alias("timed")
    )


@queries.add(
    "stream_replay",
    CHANGES
    + """SELECT 'event' AS kind, operation AS label, count(*) AS n FROM g GROUP BY ALL
UNION ALL SELECT 'change', col, count(*) FROM h GROUP BY ALL
UNION ALL SELECT 'column', t.col, count(*) FROM (SELECT DISTINCT event_type FROM g), (VALUES ('id'), ('event_type'), ('value'), ('k')) AS t(col) GROUP BY ALL
UNION ALL SELECT 'pending', 'letters', 0
UNION ALL SELECT 'replayed', status, count(*) FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'duplicate' ELSE 'replayed' END AS status FROM g WHERE event_id % 5 = 0) GROUP BY ALL""",
)
def stream_replay(spark, sf):
    """All messages are stored but for a fifth that broke downstream; its letters are replayed onto that
    store. Every other letter's event had been stored nevertheless, and is known by its position."""
    root = f"{workspace(spark)}/tables"
    rows = messages(spark, sf)
    broke = F.col("offset") % 5 == 0
    ingestion.store_batch(root)(rows.where(~broke | (F.col("offset") % 10 == 0)), 0)
    bad = ingest.filter_event_types(ingest.parse_messages(ingest.skip_tombstones(rows.where(broke))))
    bad = bad.withColumn("error", F.lit("broken downstream"))
    tables.begin(spark, root, 1)
    tables.write_batch(deadletter.dead_letters(bad, F.col("event_time")), root, "dead_letter_events", 1)
    tables.publish(spark, root, 1)
    outcome = ingestion.replay_dead_letters(
        spark, root, 1, datetime(2030, 1, 1, tzinfo=timezone.utc), limit=max(1, bad.count())
    )
    log = lambda name: tables.read_log(spark, root, name)
    counted = lambda df, kind, label: df.groupBy(
        F.lit(kind).alias("kind"), F.col(label).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    pending = deadletter.pending_count(tables.current_dead_letters(spark, root))
    return (
        counted(log("events"), "event", "operation")
        .unionByName(counted(log("column_changes"), "change", "column_name"))
        .unionByName(counted(tables.current_columns(spark, root), "column", "column_name"))
        .unionByName(pending.select(F.lit("pending").alias("kind"), F.lit("letters").alias("label"), F.col("pending").alias("n")))
        .unionByName(counted(outcome, "replayed", "status"))
    )


_RUNS = """, p AS (SELECT DISTINCT topic, part, event_id FROM g),
i AS (SELECT *, event_id - row_number() OVER (PARTITION BY topic, part, event_id // 1000000 ORDER BY event_id) AS island FROM p),
r AS (SELECT topic, part AS partition, event_id // 1000000 AS span, min(event_id) AS first_offset, max(event_id) AS last_offset
  FROM i GROUP BY topic, part, event_id // 1000000, island)
"""


@queries.add(
    "stream_position_runs",
    CDC + _RUNS + "SELECT topic, partition, span, first_offset, last_offset FROM r",
)
def stream_position_runs(spark, sf):
    """What a store knows of its positions after several batches and folding: a row per gap, not per event."""
    root = f"{workspace(spark)}/tables"
    store = ingestion.store_batch(root)
    rows = redelivered(messages(spark, sf))
    for batch_id in range(3):
        store(rows.where(F.col("offset") % 3 <= batch_id), batch_id)
    tables.compact(spark, root, "positions")
    return tables.read_log(spark, root, "positions").select("topic", "partition", "span", "first_offset", "last_offset")


@queries.add(
    "stream_counters",
    CDC
    + """, r AS (SELECT event_id FROM g UNION ALL SELECT event_id FROM g WHERE event_id % 10 = 0),
n AS (SELECT (SELECT count(*) FROM r) AS consumed, (SELECT count(*) FROM g) AS processed)
SELECT 'eventdb' AS service_name, 2 * consumed AS consumed, processed, 2 * consumed - processed AS duplicate, 0 AS failed FROM n""",
)
def stream_counters(spark, sf):
    """Counters by service after a restart at which every message comes once more."""
    where = workspace(spark)
    root = f"{where}/tables"
    path = land(spark, sf, where)
    for attempt in range(2):  # a new checkpoint: the broker delivers everything again
        source = files.read_messages(spark, path, stream=True, max_files=3)
        writer = ingestion.ingest_stream(source, root, f"{where}/checkpoint{attempt}")
        if attempt:
            store = ingestion.store_batch(root)
            writer = writer.foreachBatch(lambda df, i: store(df, 1000 + i))
        run(writer)
    return tables.counters(spark, root)


@queries.add(
    "stream_observed",
    CDC
    + """, t AS (SELECT event_id, event_id % 103 = 0 AS gone FROM c UNION ALL SELECT event_id, event_id % 103 = 0 FROM c WHERE event_id % 10 = 0)
SELECT 'messages' AS metric, CAST(NULL AS VARCHAR) AS service, count(*) AS value FROM t
UNION ALL SELECT 'tombstones', NULL, count(*) FILTER (gone) FROM t
UNION ALL SELECT 'messages', 'eventdb', count(*) FROM t
UNION ALL SELECT 'messages', 'otherdb', 0""",
)
def stream_observed(spark, sf):
    """What a stream counted on its way and reported with its progress, logged by a listener's table."""
    where = workspace(spark)
    source = files.read_messages(spark, land(spark, sf, where), stream=True, max_files=3)
    query = ingestion.ingest_stream(
        source, f"{where}/tables", f"{where}/checkpoint", services=("eventdb", "otherdb")
    ).start()
    query.awaitTermination()
    log = progress.ProgressLog(spark, f"{where}/progress")
    for report in query.recentProgress:
        found = json.loads(report.json)
        log.add(progress.progress_rows(found), progress.observed_rows(found))
    return log.counts().groupBy("metric", "service").agg(F.sum("value").alias("value"))


@queries.add(
    "stream_retention",
    CDC
    + """, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM g), cut AS (SELECT quantile_disc(day, 0.5) AS c FROM d)
SELECT strftime(ts, '%Y%m') AS month, count(*) AS n, min(ms) AS first_ms,
  (SELECT count(*) FROM g, cut WHERE ts < c) AS archived
FROM g, cut WHERE ts >= c GROUP BY 1""",
)
def stream_retention(spark, sf):
    """Whole months dropped and the boundary month rewritten on a streamed store, all archived."""
    root = ingested(spark, sf)
    days = tables.read_log(spark, root, "events").select(F.to_date("event_time").alias("day")).distinct()
    middle = days.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_date(day))").alias("c")).head().c
    cut = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(days=int(middle))
    path, archive = f"{root}/events", f"{root}/archive"
    policy = retention.Policy("events", "capture_time", 1)
    now = cut + timedelta(days=1)
    # a batch that broke off before its end is no business of retention
    tables.begin(spark, root, 10**6)
    unfinished = tables.read_log(spark, root, "events").withColumn("topic", F.lit("unfinished"))
    tables.write_batch(unfinished, root, "events", 10**6)
    visible = lambda: tables.read_log(spark, root, "events").drop("seq")
    retention.drop_months(spark, path, cut, archive, now, visible())
    retention.expire_boundary(spark, path, policy, now, f"{root}/staging", archive, visible())
    archived = spark.read.text(archive).agg(F.count(F.lit(1)).alias("archived"))
    kept = tables.read_log(spark, root, "events").groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_millis("event_time")).alias("first_ms")
    )
    return kept.withColumn("archived", archived.scalar())


@queries.add(
    "stream_compacted",
    CDC
    + """SELECT topic, count(*) AS n, sum(event_id) AS offsets, 2 AS columns_per_folder FROM g GROUP BY topic""",
)
def stream_compacted(spark, sf):
    """A store reads the same after its batches were folded, and goes on from there."""
    root = f"{workspace(spark)}/tables"
    store = ingestion.store_batch(root)
    rows = messages(spark, sf)
    for batch_id in range(4):
        store(rows.where(F.col("offset") % 5 == batch_id), batch_id)
        if batch_id == 2:
            for name in tables.SCHEMAS:
                if name not in tables.ALONE:
                    tables.compact(spark, root, name)
                    tables.vacuum(spark, root, name)
    store(rows, 4)
    found = tables.read_log(spark, root, "events")
    folders = tables.read_log(spark, root, "monitored_columns").select("batch_id").distinct()
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets")).withColumn(
        "columns_per_folder", folders.where("batch_id < 0").agg((F.count(F.lit(1)) + 1).cast("int")).scalar()
    )
