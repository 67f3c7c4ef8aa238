"""Event search, paging, statistics, feeds, dedupe."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.functions import parsing, signing
from changetide.operators import catalog, changes, dedupe, feed, ingest, runs, search, substring
from changetide.session import work_folder
from changetide.sources import broker, curve, files
from workload.samples import (
    CDC,
    CHANGES,
    Registry,
    events,
    messages,
    millis,
    parsed,
    redelivered,
    stored,
    table,
)

queries = Registry()


@queries.add(
    "events_search",
    CDC
    + """SELECT event_id AS "offset", op AS event_type, ms AS event_ms FROM g
WHERE op = 'c' AND event_type = 'purchase' AND ms BETWEEN 1704412800000 AND 1705276800000""",
)
def events_search(spark, sf):
    """Service, type and closed time range, then one table."""
    rows = search.search_events(
        stored(spark, sf),
        service_name="eventdb",
        event_type="c",
        start=datetime(2024, 1, 5, tzinfo=timezone.utc),
        end=datetime(2024, 1, 15, tzinfo=timezone.utc),
    )
    return rows.where("table_name = 'public.purchase'").select(
        "offset", "event_type", millis("event_time", "event_ms")
    )


@queries.add("events_ilike", CDC + """SELECT event_id AS "offset" FROM g WHERE event_type = 'purchase'""")
def events_ilike(spark, sf):
    """Text search ignores case, and an underscore matches any character."""
    return search.search_events(stored(spark, sf), term='TABLE":"PUR_HASE"').select("offset")


@queries.add(
    "documents_ilike",
    r"""SELECT doc_id, lang FROM documents WHERE text ILIKE '%lic_nse%granted%' OR text ILIKE '%\%%' ESCAPE '\'""",
)
def documents_ilike(spark, sf):
    """Text search over whole texts, with wildcards and with literal characters."""
    rows = table(spark, sf, "documents").withColumn("raw_payload", F.col("text"))
    wild = search.search_events(rows, term="LIC_NSE%granted")
    literal = search.search_events(rows, term="%", escape=True)
    return wild.unionByName(literal).select("doc_id", "lang").distinct()


@queries.add("events_substring", CDC + """SELECT event_id AS "offset" FROM g WHERE event_type = 'purchase'""")
def events_substring(spark, sf):
    """Text search over stored events; purchases are stored first, and the grams brought up to date for the rest."""
    folder = work_folder(spark)
    rows = stored(spark, sf).select("offset", "table_name", "raw_payload", "event_time")
    first = F.coalesce(F.col("table_name") == "public.purchase", F.lit(False))
    events_at, grams_at = f"{folder}/events", f"{folder}/grams"
    files.write_table(rows.where(first), events_at, "event_time")
    substring.grams_by_file(files.read_table(spark, events_at)).write.parquet(grams_at)
    files.write_table(rows.where(~first), events_at, "event_time")
    kept = files.read_table(spark, events_at)
    new = substring.not_indexed(kept, spark.read.parquet(grams_at))
    substring.grams_by_file(new).write.mode("append").parquet(grams_at)
    return substring.search_stored(kept, spark.read.parquet(grams_at), 'TABLE":"PUR_HASE"').select("offset")


@queries.add("documents_substring", """SELECT doc_id, lang FROM documents WHERE text ILIKE '%th_twh%erly%'""")
def documents_substring(spark, sf):
    """Text search over stored documents."""
    folder = work_folder(spark)
    table(spark, sf, "documents").write.parquet(f"{folder}/documents")
    kept = spark.read.parquet(f"{folder}/documents")
    substring.grams_by_file(kept, "text").write.parquet(f"{folder}/grams")
    found = substring.search_stored(kept, spark.read.parquet(f"{folder}/grams"), "TH_TWH%erly", column="text")
    return found.select("doc_id", "lang")


@queries.add(
    "events_page",
    CDC + """SELECT event_id AS "offset", op AS event_type FROM g ORDER BY ms DESC, event_id DESC LIMIT 100 OFFSET 50""",
)
def events_page(spark, sf):
    return search.newest_first(stored(spark, sf), limit=100, offset=50).select("offset", "event_type")


@queries.add(
    "events_keyset",
    CDC
    + """SELECT event_id AS "offset", op AS event_type FROM g
WHERE ms < 1705276800123 OR (ms = 1705276800123 AND event_id < 5000)
ORDER BY ms DESC, event_id DESC LIMIT 100""",
)
def events_keyset(spark, sf):
    at = datetime(2024, 1, 15, 0, 0, 0, 123000, tzinfo=timezone.utc)
    page = search.keyset_page(stored(spark, sf), search.Cursor(at, (5000, 0, "")), limit=100)
    return page.select("offset", "event_type")


@queries.add(
    "events_id_cursor",
    """SELECT event_id AS "offset" FROM events WHERE event_id < 3000 ORDER BY ts DESC, event_id DESC LIMIT 25""",
)
def events_id_cursor(spark, sf):
    """A cursor without a time pages by id alone."""
    rows = events(spark, sf).select(F.col("event_id").alias("offset"), F.col("ts").alias("capture_time"))
    return search.keyset_page(rows, search.Cursor(None, (3000,)), position=("offset",), limit=25).select("offset")


@queries.add(
    "record_timeline",
    CDC
    + """SELECT event_id AS "offset", operation FROM g WHERE user_id = 33 ORDER BY ms DESC, event_id DESC LIMIT 8""",
)
def record_timeline(spark, sf):
    rows = search.search_events(stored(spark, sf), row_identity='{"id": 33}')
    return search.newest_first(rows, limit=8).select("offset", "operation")


def _by_curve(spark, sf):
    """Events stored along a curve over record, time and type, and the ranges of their files."""
    at = f"{work_folder(spark)}/events"
    rows = stored(spark, sf).select("topic", "partition", "offset", "operation", "event_type", "row_identity", "event_time", "capture_time")
    rows.write.parquet(f"{at}-raw")
    columns = ("row_identity", "event_time", "event_type")
    curve.write_table(spark.read.parquet(f"{at}-raw"), at, "event_time", columns, files=32)
    kept = files.read_table(spark, at)
    curve.ranges_by_file(kept, columns).write.parquet(f"{at}-ranges")
    return kept, spark.read.parquet(f"{at}-ranges")


@queries.add("curve_timeline", CDC + """SELECT event_id AS "offset", operation FROM g WHERE user_id = 33""")
def curve_timeline(spark, sf):
    """The timeline of a record from the files whose ranges hold it."""
    kept, ranges = _by_curve(spark, sf)
    return curve.between(kept, ranges, row_identity=('{"id":33}', '{"id":33}')).select("offset", "operation")


@queries.add(
    "curve_time_range",
    CDC + """SELECT event_id AS "offset", operation FROM g WHERE ms BETWEEN 1704844800000 AND 1705276800000""",
)
def curve_time_range(spark, sf):
    """The same table by a range of time."""
    kept, ranges = _by_curve(spark, sf)
    span = datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 15, tzinfo=timezone.utc)
    return curve.between(kept, ranges, event_time=span).select("offset", "operation")


@queries.add("filtered_total", CDC + "SELECT count(*) AS total FROM g WHERE op = 'u'")
def filtered_total(spark, sf):
    return search.total(search.search_events(stored(spark, sf), event_type="u"))


_STATS = """SELECT 'service' AS dimension, service AS value, count(*) AS n FROM v GROUP BY service
UNION ALL SELECT 'type', type, count(*) FROM v GROUP BY type
UNION ALL SELECT 'operation', operation, count(*) FROM v GROUP BY operation
UNION ALL SELECT 'total', 'all', count(*) FROM v"""


def _services(spark, sf):
    return events(spark, sf).select(
        F.expr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('t', user_id % 3) END").alias("service_name"),
        F.expr("CASE WHEN event_id % 40 = 0 THEN '' ELSE event_type END").alias("event_type"),
        parsing.operation(F.col("op")).alias("operation"),
    )


_SERVICES = """, v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE 't' || user_id % 3 END AS service,
  CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE event_type END AS type, operation FROM c {where})
"""


@queries.add("event_stats", CDC + _SERVICES.format(where="") + _STATS)
def event_stats(spark, sf):
    """Counts by service, type and operation and the total; missing keys are unknown."""
    return search.event_stats(_services(spark, sf))


@queries.add(
    "tenant_stats",
    CDC + _SERVICES.format(where="WHERE event_id % 50 <> 0 AND user_id % 3 = 1") + _STATS,
)
def tenant_stats(spark, sf):
    return search.event_stats(_services(spark, sf), tenant="t1")


@queries.add(
    "tenant_scope",
    "SELECT event_id FROM events WHERE user_id % 3 = 2",
)
def tenant_scope(spark, sf):
    rows = events(spark, sf).withColumn("service_name", F.expr("concat('t', user_id % 3)"))
    return search.tenant_scope(rows, "t2", requested="t2").select("event_id")


def _feed(spark, sf):
    """Feed rows with one service per tenant."""
    rows = stored(spark, sf).withColumn("service_name", F.col("tenant_id"))
    return feed.feed_rows(rows)


@queries.add(
    "tenant_feed",
    CDC
    + """SELECT event_id AS "offset", '{"id":{"topic":"' || topic || '","partition":' || part || ',"offset":' || event_id ||
  '},"event_type":"' || op || '"' AS head FROM g WHERE user_id % 3 = 1""",
)
def tenant_feed(spark, sf):
    """Messages one tenant's subscriber receives."""
    rows = feed.feed_for(_feed(spark, sf), "t1")
    head = F.regexp_extract("body", r'^\{"type":"new_event","event":(.*?"event_type":"[a-z]+")', 1)
    return rows.select("offset", head.alias("head"))


@queries.add(
    "feed_fan_out",
    CDC
    + """SELECT subscriber, count(*) AS n, sum(event_id) AS offsets
FROM g JOIN (SELECT s_name AS subscriber, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 't' || s_suppkey % 4 END AS tenant
  FROM supplier) s ON s.tenant IS NULL OR s.tenant = 't' || user_id % 3
GROUP BY subscriber""",
)
def feed_fan_out(spark, sf):
    """What every subscriber gets: its tenant's events, or all without a tenant. Counted per channel
    first, so the pairs of events and subscribers are never made."""
    listeners = table(spark, sf, "supplier").select(
        F.col("s_name").alias("subscriber"),
        F.expr("CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE concat('t', s_suppkey % 4) END").alias("tenant"),
    )
    volume = {"n": F.count(F.lit(1)), "offsets": F.sum("offset")}
    return feed.fan_out_totals(_feed(spark, sf).drop("body"), listeners, volume)


@queries.add(
    "feed_offers",
    CDC
    + """SELECT subscriber, event_id AS "offset"
FROM g JOIN (SELECT n_name AS subscriber, CASE WHEN n_nationkey = 7 THEN NULL ELSE 't' || n_nationkey % 4 END AS tenant
  FROM nation) s ON s.tenant IS NULL OR s.tenant = 't' || user_id % 3""",
)
def feed_offers(spark, sf):
    """Every message with each of its subscribers, one row per delivery."""
    listeners = table(spark, sf, "nation").select(
        F.col("n_name").alias("subscriber"),
        F.expr("CASE WHEN n_nationkey = 7 THEN NULL ELSE concat('t', n_nationkey % 4) END").alias("tenant"),
    )
    return feed.fan_out(_feed(spark, sf).drop("body"), listeners).select("subscriber", "offset")


@queries.add("feed_distinct", CDC + """SELECT event_id AS "offset" FROM c""")
def feed_distinct(spark, sf):
    return feed.distinct_feed(redelivered(messages(spark, sf))).select("offset")


@queries.add("notified_events", CDC + """SELECT event_id AS "offset" FROM g WHERE event_id % 10 = 0""")
def notified_events(spark, sf):
    notices = messages(spark, sf).where("offset % 10 = 0").select("topic", "partition", "offset")
    return feed.notified_events(stored(spark, sf), notices).select("offset")


@queries.add(
    "signed_deliveries",
    r"""WITH k AS (SELECT 'public-sample-key' AS s),
p AS (SELECT string_agg(chr(CAST(xor(CASE WHEN i <= length(s) THEN ascii(substr(s, i, 1)) ELSE 0 END, 54) AS INTEGER)), '' ORDER BY i) AS ipad,
  string_agg(chr(CAST(xor(CASE WHEN i <= length(s) THEN ascii(substr(s, i, 1)) ELSE 0 END, 92) AS INTEGER)), '' ORDER BY i) AS opad
  FROM k, range(1, 65) t(i))
SELECT doc_id, 'sha256=' || sha256(encode(opad) || unhex(sha256(encode(ipad) || encode(text)))) AS signature FROM documents, p""",
)
def signed_deliveries(spark, sf):
    """HMAC-SHA256 of whole texts."""
    docs = table(spark, sf, "documents")
    signed = feed.deliveries(docs.withColumn("body", F.col("text")), "public-sample-key")
    return signed.select("doc_id", F.col("headers")["X-Signature"].alias("signature"))


@queries.add(
    "dedupe_positions",
    CDC + "SELECT topic, count(*) AS n, sum(event_id) AS offsets FROM c GROUP BY topic",
)
def dedupe_positions(spark, sf):
    rows = dedupe.distinct_positions(redelivered(messages(spark, sf)))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))


@queries.add(
    "dedupe_without_position",
    """SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS "offset",
  CASE WHEN event_id % 3 = 0 AND event_id % 10 = 0 THEN 2 * count(*) ELSE count(*) END AS n
FROM events GROUP BY event_id""".replace(
        "SELECT CASE", "SELECT \"offset\", sum(n) AS n FROM (SELECT CASE", 1
    )
    + ') GROUP BY "offset"',
)
def dedupe_without_position(spark, sf):
    """Rows without a full position never conflict."""
    rows = redelivered(messages(spark, sf)).withColumn(
        "offset", F.expr("CASE WHEN offset % 3 = 0 THEN NULL ELSE offset END")
    )
    return dedupe.distinct_positions(rows).groupBy("offset").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))


@queries.add(
    "insert_ignore",
    CDC + """SELECT event_id AS "offset", op AS event_type FROM g WHERE event_id % 4 <> 0""",
)
def insert_ignore(spark, sf):
    """Rows of a batch with repeats whose position is not stored yet."""
    rows = stored(spark, sf)
    return dedupe.new_positions(redelivered(rows), rows.where("offset % 4 = 0")).select("offset", "event_type")


@queries.add(
    "insert_ignore_runs",
    CDC + """SELECT event_id AS "offset", op AS event_type FROM g WHERE event_id % 4 <> 0""",
)
def insert_ignore_runs(spark, sf):
    """The same against runs of stored positions."""
    rows = stored(spark, sf)
    known = runs.runs_of(rows.where("offset % 4 = 0"))
    return runs.new_positions(redelivered(rows), known).select("offset", "event_type")


_ISLANDS = """, i AS (SELECT DISTINCT topic, part, event_id FROM g),
j AS (SELECT *, event_id - row_number() OVER (PARTITION BY topic, part ORDER BY event_id) AS island FROM i)
"""


@queries.add(
    "position_runs",
    CDC
    + _ISLANDS
    + """SELECT topic, part AS partition, min(event_id) AS first_offset, max(event_id) AS last_offset
FROM j GROUP BY topic, part, event_id // 1000000, island""",
)
def position_runs(spark, sf):
    """Stored positions as runs without gaps."""
    found = runs.runs_of(redelivered(stored(spark, sf)))
    return found.select("topic", "partition", "first_offset", "last_offset")


@queries.add(
    "position_gaps",
    CDC
    + _ISLANDS
    + """, r AS (SELECT topic, part AS partition, min(event_id) AS a, max(event_id) AS b FROM j GROUP BY topic, part, island),
n AS (SELECT *, lead(a) OVER (PARTITION BY topic, partition ORDER BY a) AS after FROM r)
SELECT topic, partition, b + 1 AS first_offset, after - 1 AS last_offset FROM n WHERE after IS NOT NULL""",
)
def position_gaps(spark, sf):
    """Offsets missing between stored ones: lost messages, or ones that became dead letters."""
    return runs.missing_runs(runs.runs_of(stored(spark, sf)))


@queries.add(
    "inserted_events",
    CDC + """SELECT event_id AS "offset" FROM m WHERE event_id % 4 <> 0""",
)
def inserted_events(spark, sf):
    """The batch is parsed once and stored: it is asked three times for its positions."""
    path = f"{work_folder(spark)}/parsed"
    made = parsed(spark, sf)
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    inserted = dedupe.new_positions(rows, rows.where("offset % 4 = 0"))
    return dedupe.inserted_events(rows, inserted).select("offset")


@queries.add(
    "ingestion_latency",
    CDC
    + """SELECT event_id, round((epoch_us(ts) - ms * 1000 + (event_id % 7 - 2) * 1000000) / 1000000.0, 6) AS latency_seconds
FROM c WHERE epoch_us(ts) - ms * 1000 + (event_id % 7 - 2) * 1000000 >= 0""",
)
def ingestion_latency(spark, sf):
    """Latency in seconds; negative samples are left out."""
    rows = events(spark, sf).select(
        "event_id",
        F.timestamp_millis(F.unix_millis("ts")).alias("event_time"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 7 - 2) * 1_000_000).alias("ingested_at"),
    )
    return search.ingestion_latency(rows).select("event_id", F.round("latency_seconds", 6).alias("latency_seconds"))


@queries.add(
    "month_partitions",
    """SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1""",
)
def month_partitions(spark, sf):
    rows = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return files.partition_by_month(rows, "o_orderdate").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@queries.add(
    "fallback_events",
    CDC
    + """SELECT event_id AS "offset", 'unparsed' AS event_type, 'eventdb' AS service_name, 'UNKNOWN' AS operation FROM c""",
)
def fallback_events(spark, sf):
    return ingest.fallback_event(messages(spark, sf)).select("offset", "event_type", "service_name", "operation")


_LONG_KEY = "k" * 100
_PADS = [
    bytes(b ^ pad for b in hashlib.sha256(_LONG_KEY.encode()).digest().ljust(64, b"\0")).hex()
    for pad in (0x36, 0x5C)
]


@queries.add(
    "hmac_of_keys",
    f"""SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS signature
FROM customer""",
)
def hmac_of_keys(spark, sf):
    """HMAC under a key longer than a hash block."""
    return table(spark, sf, "customer").select(
        "c_custkey", signing.hmac_sha256(F.col("c_name"), _LONG_KEY).alias("signature")
    )


@queries.add(
    "events_cursor_round_trip",
    CDC
    + """SELECT event_id AS "offset", ms AS event_ms, CASE WHEN rn <= 40 THEN total END AS total FROM
(SELECT event_id, ms, row_number() OVER (ORDER BY ms DESC, event_id DESC) AS rn, count(*) OVER () AS total FROM g) WHERE rn <= 120""",
)
def events_cursor_round_trip(spark, sf):
    """Three pages in a row over a stored table; each cursor goes through its text, the first page
    alone has the total."""
    path = f"{work_folder(spark)}/events"
    files.write_table(stored(spark, sf), path, "capture_time")
    kept = files.read_table(spark, path).select("topic", "partition", "offset", "capture_time", "month")
    pages, cursor = [], None
    for _ in range(3):
        page = search.page_with_total(kept, cursor, limit=40)
        pages.append(page)
        after = search.next_cursor(page.collect(), 40)
        if after is None:
            break
        cursor = search.read_cursor(search.cursor_text(after))
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page)
    return every.select("offset", millis("capture_time", "event_ms"), "total")


@queries.add(
    "changes_page_stored",
    CHANGES
    + """SELECT event_id AS "offset", col AS column_name, new_value FROM h
WHERE ms < 1705276800000 ORDER BY ms DESC, event_id DESC, col DESC LIMIT 40""",
)
def changes_page_stored(spark, sf):
    """A page of the stored changes; time and month are filtered in the scan."""
    path = f"{work_folder(spark)}/changes"
    files.write_table(changes.column_deltas(stored(spark, sf)), path, "changed_at")
    kept = files.read_table(spark, path)
    at = search.Cursor(datetime(2024, 1, 15, tzinfo=timezone.utc), (-1, ""))
    page = search.keyset_page(kept, at, "changed_at", ("offset", "column_name"), 40)
    return page.select("offset", "column_name", "new_value")


@queries.add(
    "named_changes",
    CHANGES + """SELECT event_id AS "offset", col AS column_name, new_value FROM h""",
)
def named_changes(spark, sf):
    """Changes stored with column ids get their names back from the catalog."""
    rows = stored(spark, sf)
    columns = catalog.discover_columns(rows)
    found = changes.name_columns(changes.column_changes(rows, columns).drop("column_name"), columns)
    return found.select("offset", "column_name", "new_value")


@queries.add(
    "event_responses",
    CDC
    + """SELECT event_id AS "offset", topic, op AS event_type, 'eventdb' AS service_name, operation, ms AS event_ms FROM g""",
)
def event_responses(spark, sf):
    """Events as an event query returns them."""
    rows = search.event_response(stored(spark, sf))
    return rows.select("offset", "topic", "event_type", "service_name", "operation", millis("event_time", "event_ms"))


@queries.add(
    "change_responses",
    CHANGES + """SELECT event_id AS "offset", col AS column_name, operation, old_value, new_value FROM h""",
)
def change_responses(spark, sf):
    rows = changes.change_response(changes.column_deltas(stored(spark, sf)))
    return rows.select("offset", "column_name", "operation", "old_value", "new_value")


@queries.add(
    "processed_events",
    CDC + """SELECT event_id AS "offset", CASE WHEN user_id <> 0 THEN 'user-' || user_id END AS user_id FROM g""",
)
def processed_events(spark, sf):
    """A step under its import path runs between filters and masks."""
    rows = ingest.prepare_events(messages(spark, sf), processors=["workload.samples:tag_users"])
    return rows.select("offset", "user_id")


@queries.add(
    "unreadable_bytes",
    """SELECT doc_id AS "offset", CASE WHEN doc_id % 3 = 0 THEN 'invalid UTF-8' END AS error FROM documents""",
)
def unreadable_bytes(spark, sf):
    """Strict decoding: a message with a wrong byte is an error row, with the byte replaced."""
    docs = table(spark, sf, "documents")
    good = F.to_json(F.struct(F.left("text", F.lit(200)).alias("text")))
    value = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.encode(good, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(good, "UTF-8"))
    rows = docs.select(
        F.lit("docs.text").alias("topic"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"), value.alias("value"),
    )
    return ingest.parse_messages(rows).select("offset", "error")


@queries.add(
    "sorted_columns",
    CDC
    + """SELECT t.table_name, col AS column_name, row_number() OVER (PARTITION BY t.table_name ORDER BY col) AS place
FROM (SELECT DISTINCT 'public.' || event_type AS table_name FROM g) t, (VALUES ('id'), ('event_type'), ('value'), ('k')) AS c(col)""",
)
def sorted_columns(spark, sf):
    """Columns of each table in the order in which they are listed."""
    rows = stored(spark, sf)
    listed = catalog.columns_by_name(catalog.discover_columns(rows))
    place = F.row_number().over(W.partitionBy("table_id").orderBy("column_name")).cast("long")
    names = catalog.discover_tables(rows).select("table_id", "table_name")
    return listed.withColumn("place", place).join(names, "table_id").select("table_name", "column_name", "place")


@queries.add(
    "monthly_layout",
    """SELECT strftime(ts, '%Y%m') AS month, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1""",
)
def monthly_layout(spark, sf):
    """An unpartitioned table rewritten by month."""
    path = f"{work_folder(spark)}/events"
    files.write_table(events(spark, sf), path, "ts")
    return files.read_table(spark, path).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@queries.add(
    "clusters_united",
    CDC
    + """SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'east' ELSE 'west' END AS cluster FROM c) GROUP BY cluster""",
)
def clusters_united(spark, sf):
    """Messages of several clusters in one frame, each with the name of its cluster."""
    rows = messages(spark, sf)
    parts = {"east": rows.where("offset % 2 = 0"), "west": rows.where("offset % 2 = 1")}
    return broker.united(parts).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
