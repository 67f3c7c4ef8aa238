"""Column changes, history pages, point-in-time values and current state."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from changetide.functions import origin
from changetide.operators import catalog, changes, ordered, search, validity
from changetide.session import work_folder
from changetide.sources import keyed
from workload.samples import CDC, CHANGES, Registry, events, millis, stored

queries = Registry()

AT = datetime(2024, 1, 15, tzinfo=timezone.utc)
SMALL = ordered.Slicing(hot_rows=200, parts=8, tie_rows=1000)


def _catalog(rows):
    return catalog.discover_tables(rows), catalog.discover_columns(rows)


def all_changes(spark, sf):
    rows = stored(spark, sf)
    return changes.column_changes(rows, catalog.discover_columns(rows))


def deltas(spark, sf):
    return changes.column_deltas(stored(spark, sf))


@queries.add(
    "column_changes",
    CHANGES
    + """SELECT event_id AS "offset", col AS column_name, operation, old_value, new_value, ms AS changed_ms FROM h""",
)
def column_changes(spark, sf):
    """Changed columns of every event, joined to the audited catalog columns."""
    return all_changes(spark, sf).select(
        "offset", "column_name", "operation", "old_value", "new_value", millis("changed_at", "changed_ms")
    )


@queries.add(
    "column_changes_audited",
    CHANGES
    + """SELECT event_type, col AS column_name, count(*) AS n FROM h WHERE col <> 'value' GROUP BY 1, 2""",
)
def column_changes_audited(spark, sf):
    """A column whose audit switch is off leaves no changes."""
    rows = stored(spark, sf)
    columns = catalog.discover_columns(rows).withColumn(
        "audit_enabled", F.col("column_name") != "value"
    )
    found = changes.column_changes(rows, columns)
    return found.groupBy(
        F.split_part("topic", F.lit("."), F.lit(3)).alias("event_type"), "column_name"
    ).agg(F.count(F.lit(1)).alias("n"))


@queries.add(
    "changes_history",
    CHANGES
    + """SELECT event_id AS "offset", col AS column_name, new_value, ms AS changed_ms FROM h
WHERE event_type = 'view' AND col = 'k' AND user_id = 12
  AND ms BETWEEN 1704153600000 AND 1706140800000""",
)
def changes_history(spark, sf):
    """One column of one row of one table, in a closed time range."""
    table_id = origin.table_id(F.lit("eventdb"), F.lit("analytics"), F.lit("public.view"))
    rows = deltas(spark, sf).where(F.col("table_id") == table_id)
    return changes.history(
        rows,
        column_name="k",
        row_identity='{ "id" : 12 }',
        start=datetime(2024, 1, 2, tzinfo=timezone.utc),
        end=datetime(2024, 1, 25, tzinfo=timezone.utc),
    ).select("offset", "column_name", "new_value", millis("changed_at", "changed_ms"))


@queries.add(
    "changes_newest",
    CHANGES
    + """SELECT event_id AS "offset", col AS column_name, old_value, new_value FROM h
WHERE event_type = 'error' ORDER BY ms DESC, event_id DESC, col DESC LIMIT 50 OFFSET 20""",
)
def changes_newest(spark, sf):
    rows = deltas(spark, sf).where(F.col("topic") == "eventdb.public.error")
    page = search.newest_first(rows, "changed_at", ("offset", "column_name"), limit=50, offset=20)
    return page.select("offset", "column_name", "old_value", "new_value")


@queries.add(
    "changes_keyset",
    CHANGES
    + """SELECT event_id AS "offset", col AS column_name, new_value FROM h
WHERE ms < 1705276800000 OR (ms = 1705276800000 AND (event_id < 100 OR (event_id = 100 AND col < 'k')))
ORDER BY ms DESC, event_id DESC, col DESC LIMIT 40""",
)
def changes_keyset(spark, sf):
    page = search.keyset_page(
        deltas(spark, sf), search.Cursor(AT, (100, "k")), "changed_at", ("offset", "column_name"), 40
    )
    return page.select("offset", "column_name", "new_value")


@queries.add(
    "value_at_time",
    CHANGES
    + """SELECT 'analytics' AS database_name, arg_max(struct_pack(v := new_value), (ms, event_id)).v AS value,
  max(ms) AS changed_ms, true AS found
FROM h WHERE event_type = 'purchase' AND col = 'value' AND ms <= 1705276800000""",
)
def value_at_time(spark, sf):
    """Latest change of a column over all rows of its table."""
    rows = stored(spark, sf)
    hit = changes.value_at(
        changes.column_deltas(rows), catalog.discover_tables(rows),
        "eventdb", "public.purchase", "value", AT,
    )
    return hit.select("database_name", "value", millis("changed_at", "changed_ms"), "found")


_BULK = """, l AS (SELECT event_id AS ask, event_type, user_id, col, epoch_us(ts) + 3600000000 AS at
  FROM c, (VALUES ('id'), ('event_type'), ('value'), ('k')) AS t(col)),
p AS (SELECT ask, l.event_type, l.user_id, l.col, h.ms, h.event_id, h.new_value,
  row_number() OVER (PARTITION BY ask, l.col ORDER BY h.ms DESC, h.event_id DESC) AS rn
  FROM l LEFT JOIN h ON h.event_type = l.event_type AND h.user_id = l.user_id AND h.col = l.col
    AND h.ms * 1000 <= l.at)
SELECT ask, col AS column_name, new_value AS value, ms AS changed_ms, ms IS NOT NULL AS found
FROM p WHERE rn = 1"""


def _asked(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("ask"),
        origin.table_id(
            F.lit("eventdb"), F.lit("analytics"), F.concat(F.lit("public."), "event_type")
        ).alias("table_id"),
        F.explode(F.array(*map(F.lit, ("id", "event_type", "value", "k")))).alias("column_name"),
        F.format_string('{"id":%d}', "user_id").alias("row_identity"),
        F.timestamp_micros(F.unix_micros("ts") + 3_600_000_000).alias("at"),
    )


def _bulk(spark, sf, slicing):
    return changes.values_at(deltas(spark, sf), _asked(spark, sf), slicing=slicing).select(
        "ask", "column_name", "value", millis("changed_at", "changed_ms"), "found"
    )


def _history(spark, sf):
    """Intervals kept in a table by key, from batches that arrive out of order."""
    name = f"{keyed.database(spark, work_folder(spark))}.intervals"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facts = deltas(spark, sf)
    for batch in (1, 2, 0):
        late = validity.intervals(facts.where(F.col("offset") % 3 == batch))
        keyed.merge(spark, name, late, validity.KEY, buckets, validity.merged)
    return spark.table(name)


@queries.add("values_at_intervals", CHANGES + _BULK)
def values_at_intervals(spark, sf):
    """The same lookups on stored intervals."""
    return validity.values_at(_history(spark, sf), _asked(spark, sf)).select(
        "ask", "column_name", "value", millis("changed_at", "changed_ms"), "found"
    )


@queries.add(
    "snapshot_at_time",
    CHANGES
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, col ORDER BY ms DESC, event_id DESC) AS rn
  FROM h WHERE ms <= 1705276800000)
SELECT user_id, event_type AS "table", col AS column_name, new_value, ms AS from_ms FROM s WHERE rn = 1""",
)
def snapshot_at_time(spark, sf):
    """Every column of every row as it was at a time: a filter on the stored intervals."""
    names = events(spark, sf).select("event_type").distinct().select(
        F.col("event_type").alias("table"),
        origin.table_id(F.lit("eventdb"), F.lit("analytics"), F.concat(F.lit("public."), "event_type")).alias("table_id"),
    )
    found = validity.snapshot(_history(spark, sf), AT).join(names, "table_id")
    return found.select(
        F.get_json_object("row_identity", "$.id").cast("bigint").alias("user_id"),
        "table",
        "column_name",
        "new_value",
        millis("valid_from", "from_ms"),
    )


@queries.add("values_at_bulk", CHANGES + _BULK)
def values_at_bulk(spark, sf):
    """Row-scoped values for many (row, column, time) lookups at once."""
    return _bulk(spark, sf, ordered.DEFAULT)


@queries.add(
    "values_at_by_column",
    CHANGES
    + """, l AS (SELECT event_id AS ask, event_type, epoch_us(ts) AS at FROM c),
p AS (SELECT ask, h.ms, h.event_id, h.new_value,
  row_number() OVER (PARTITION BY ask ORDER BY h.ms DESC, h.event_id DESC) AS rn
  FROM l LEFT JOIN h ON h.event_type = l.event_type AND h.col = 'k' AND h.ms * 1000 <= l.at)
SELECT ask, new_value AS value, ms IS NOT NULL AS found FROM p WHERE rn = 1""",
)
def values_at_by_column(spark, sf):
    """Table-scoped lookups: few hot keys, each cut into time slices."""
    facts = deltas(spark, sf).where(F.col("column_name") == "k")
    lookups = events(spark, sf).select(
        F.col("event_id").alias("ask"),
        origin.table_id(
            F.lit("eventdb"), F.lit("analytics"), F.concat(F.lit("public."), "event_type")
        ).alias("table_id"),
        F.lit("k").alias("column_name"),
        F.col("ts").alias("at"),
    )
    found = changes.values_at(facts, lookups, ("table_id", "column_name"), SMALL)
    return found.select("ask", "value", "found")


_STATE = """, s AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ms DESC, event_id DESC) AS rn FROM g)
"""


@queries.add(
    "current_state",
    CDC
    + _STATE
    + """SELECT '{"id":' || id_json || '}' AS row_identity, operation, ms AS event_ms,
  '{"event_type":' || a_type || ',"id":' || id_json || ',"k":' || a_k || ',"value":' || a_value || '}' AS "row"
FROM s WHERE rn = 1 AND op <> 'd'""",
)
def current_state(spark, sf):
    """Latest image of every row that still exists."""
    return changes.current_state(stored(spark, sf)).select(
        "row_identity", "operation", millis("event_time", "event_ms"), "row"
    )


@queries.add(
    "state_by_merges",
    CDC
    + _STATE
    + """SELECT event_type AS table_id, '{"id":' || id_json || '}' AS row_identity, operation, ms AS event_ms FROM s WHERE rn = 1 AND op <> 'd'""",
)
def state_by_merges(spark, sf):
    """Row states kept in a table by key, batch after batch, each out of order with the others."""
    name = f"{keyed.database(spark, work_folder(spark))}.states"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(spark, sf).withColumn("table_id", F.split_part("topic", F.lit("."), F.lit(3)))
    for batch in (2, 0, 1):
        states = changes.current_state(rows.where(F.col("offset") % 3 == batch), keep_deleted=True, positions=True)
        keyed.merge(spark, name, states, changes.STATE_KEY, buckets, changes.merge_state)
    return spark.table(name).where("operation <> 'DELETE'").select(
        "table_id", "row_identity", "operation", millis("event_time", "event_ms")
    )


@queries.add(
    "field_timeline",
    CHANGES
    + """SELECT g.event_id AS "offset", g.op AS event_type, h.col AS column_name, h.old_value, h.new_value
FROM g JOIN h USING (event_id) WHERE g.user_id = 12""",
)
def field_timeline(spark, sf):
    """Events of one record linked to the changes they caused."""
    rows = stored(spark, sf)
    record = search.search_events(rows, row_identity='{"id":12}')
    return changes.field_timeline(record, changes.column_deltas(record)).select(
        "offset", "event_type", "column_name", "old_value", "new_value"
    )


@queries.add(
    "newest_event_per_table",
    CDC
    + """SELECT 'public.' || event_type AS table_name, max(event_id) AS "offset" FROM
(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, event_id DESC) AS rn FROM g)
WHERE rn = 1 GROUP BY 1""",
)
def newest_event_per_table(spark, sf):
    rows = stored(spark, sf).select("table_name", "event_time", "offset")
    return search.latest_per_key(rows, ("table_name",), ("event_time", "offset")).select(
        "table_name", "offset"
    )
