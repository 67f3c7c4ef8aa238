"""Readable forms of events: diffs, summaries, labels, decoded values."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from changetide.functions import deep, present, values
from changetide.operators import ingest
from workload.samples import CDC, CHANGES, Registry, events, parsed, table

queries = Registry()

NOW = datetime(2024, 1, 16, tzinfo=timezone.utc)


def rows(spark, sf):
    """Events with both row versions as maps."""
    return ingest.envelope_rows(ingest.filter_event_types(parsed(spark, sf)))


def triples():
    return present.diff_triples(F.col("before_row"), F.col("after_row"))


# A diff looks at before and after whatever the operation is.
_DIFF = CHANGES.replace("operation = 'INSERT' OR NOT has_before", "NOT has_before").replace(
    "operation = 'DELETE' OR NOT has_after", "NOT has_after"
) + """, d AS (SELECT event_id, operation, col, coalesce(trim(old_value, '"'), 'null') AS old,
  coalesce(trim(new_value, '"'), 'null') AS new FROM h)
"""


@queries.add(
    "diff_triples", _DIFF + 'SELECT event_id AS "offset", col AS field, old, new FROM d'
)
def diff_triples(spark, sf):
    return rows(spark, sf).select("offset", F.inline(triples()))


@queries.add(
    "change_summary",
    _DIFF
    + """, n AS (SELECT event_id, any_value(operation) AS operation, count(*) AS n,
  string_agg(col, ', ' ORDER BY col) AS cols, any_value(col || ': ' || old || ' -> ' || new) AS one FROM d GROUP BY event_id)
SELECT g.event_id AS "offset", CASE WHEN n IS NULL THEN upper(g.operation[1]) || lower(g.operation[2:]) || ' event'
  WHEN n = 1 THEN one WHEN n <= 3 THEN cols || ' changed' ELSE n || ' fields changed' END AS summary
FROM g LEFT JOIN n USING (event_id)""",
)
def change_summary(spark, sf):
    return rows(spark, sf).select(
        "offset", present.change_summary(triples(), F.col("operation")).alias("summary")
    )


@queries.add(
    "state_pairs",
    CDC
    + """, p AS (SELECT event_id, 'event_type' AS field, b_type AS b, a_type AS a, has_before, has_after FROM g
  UNION ALL SELECT event_id, 'id', id_json, id_json, has_before, has_after FROM g
  UNION ALL SELECT event_id, 'k', b_k, a_k, has_before, has_after FROM g
  UNION ALL SELECT event_id, 'value', b_value, a_value, has_before, has_after FROM g)
SELECT event_id AS "offset", field, CASE WHEN has_before THEN coalesce(trim(b, '"'), 'null') ELSE 'null' END AS "before",
  CASE WHEN has_after THEN coalesce(trim(a, '"'), 'null') ELSE 'null' END AS "after" FROM p""",
)
def state_pairs(spark, sf):
    pairs = present.state_pairs(F.col("before_row"), F.col("after_row"))
    return rows(spark, sf).select("offset", F.inline(pairs))


@queries.add(
    "row_snapshot",
    CDC
    + """SELECT event_id AS "offset", CASE WHEN has_after THEN a_k WHEN b_k IS NULL THEN 'null' ELSE b_k END AS k FROM g""",
)
def row_snapshot(spark, sf):
    row = present.snapshot(F.col("before_row"), F.col("after_row"))
    return rows(spark, sf).select("offset", F.to_json(F.try_element_at(row, F.lit("k"))).alias("k"))


@queries.add(
    "record_label",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name=' || c_name || ', id=' || c_custkey
  WHEN c_custkey % 3 = 1 THEN 'id=' || c_custkey || ', nation_id=' || c_nationkey
  ELSE 'balance=' || c_nationkey || ', segment=' || c_mktsegment END AS label FROM customer""",
)
def record_label(spark, sf):
    """A business key and an identity key, two identity keys, or any two fields."""
    doc = F.expr(
        """CASE c_custkey % 3
        WHEN 0 THEN to_json(named_struct('id', c_custkey, 'name', c_name, 'email', '', 'nation_id', c_nationkey))
        WHEN 1 THEN to_json(named_struct('id', c_custkey, 'nation_id', c_nationkey, 'bidder', 1))
        ELSE to_json(named_struct('segment', c_mktsegment, 'balance', c_nationkey)) END"""
    )
    row = F.try_variant_get(values.parse_json(doc), "$", values.ROW_TYPE)
    none = F.try_variant_get(F.parse_json(F.lit("null")), "$", values.ROW_TYPE)
    return table(spark, sf, "customer").select(
        "c_custkey", row.alias("row")
    ).select("c_custkey", present.record_label(none, F.col("row")).alias("label"))


@queries.add(
    "record_label_with_identity",
    """SELECT c_custkey, 'name=' || c_name || ', id=' || (c_custkey + 1) AS label FROM customer""",
)
def record_label_with_identity(spark, sf):
    """The stored identity overlays the row."""
    as_row = lambda c: F.try_variant_get(values.parse_json(c), "$", values.ROW_TYPE)
    doc = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    stored = F.to_json(F.struct((F.col("c_custkey") + 1).alias("id")))
    return (
        table(spark, sf, "customer")
        .select("c_custkey", as_row(doc).alias("row"), as_row(stored).alias("identity"))
        .select(
            "c_custkey",
            present.record_label(F.col("row"), F.col("row"), F.col("identity")).alias("label"),
        )
    )


@queries.add(
    "time_like_numbers",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
  ELSE strftime(make_timestamp(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000
    ELSE epoch_us(ts) // 1000000 * 1000000 END), '%Y-%m-%dT%H:%M:%S') || CASE
    WHEN event_id % 4 = 2 OR (event_id % 4 = 0 AND epoch_us(ts) % 1000000 = 0) OR (event_id % 4 = 1 AND epoch_us(ts) // 1000 % 1000 = 0) THEN ''
    WHEN event_id % 4 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')
    WHEN event_id % 4 = 1 THEN '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '000' ELSE '' END || '+00:00' END AS shown
FROM events""",
)
def time_like_numbers(spark, sf):
    """Micro-, milli- and plain seconds under a time-like name, and under another."""
    number = F.expr(
        """CASE event_id % 4 WHEN 0 THEN unix_micros(ts) WHEN 1 THEN unix_millis(ts) ELSE unix_seconds(ts) END"""
    )
    name = F.expr(
        "CASE event_id % 4 WHEN 0 THEN 'Updated_At' WHEN 1 THEN 'orderDate' WHEN 2 THEN 'time' ELSE 'total' END"
    )
    return events(spark, sf).select(
        "event_id", present.shown(values.parse_json(number.cast("string")), name).alias("shown")
    )


@queries.add(
    "decimal_decode",
    """SELECT l_orderkey, l_linenumber,
  CASE WHEN c < 0 THEN '-' ELSE '' END || CASE WHEN length(d) <= 3 THEN '0.' || lpad(d, 3, '0')
    ELSE left(d, length(d) - 3) || '.' || right(d, 3) END AS text
FROM (SELECT *, CAST(abs(c) AS VARCHAR) AS d FROM (SELECT l_orderkey, l_linenumber,
  CAST(l_quantity * 1000 - l_linenumber * 9000 AS BIGINT) * 7 AS c FROM lineitem))""",
)
def decimal_decode(spark, sf):
    """Signed big-endian bytes with a scale."""
    number = F.expr("CAST(l_quantity * 1000 - l_linenumber * 9000 AS BIGINT) * 7")
    doc = F.concat(F.lit('{"scale":3,"value":"'), F.base64(F.unhex(F.hex(number))), F.lit('"}'))
    # hex() drops leading zeros of positive numbers, which would then read as negative.
    padded = F.concat(
        F.lit('{"scale":3,"value":"'),
        F.base64(F.unhex(F.lpad(F.hex(number), 16, "0"))),
        F.lit('"}'),
    )
    chosen = F.when(number < 0, doc).otherwise(padded)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        present.decimal_text(values.parse_json(chosen)).alias("text"),
    )


@queries.add(
    "normalise_deep",
    CDC
    + """SELECT event_id, '{"rows":[{"created_at":"' || strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') ||
  '+00:00","price":"1.23"}],"total":' || k || '}' AS doc FROM c""",
)
def normalise_deep(spark, sf):
    """Times and decimals below the first level."""
    doc = F.concat(
        F.lit('{"total":'), "k", F.lit(',"rows":[{"price":{"scale":2,"value":"ew=="},"created_at":'),
        F.expr("unix_seconds(ts)"), F.lit("}]}"),
    )
    return events(spark, sf).select("event_id", deep.normalise_json(doc).alias("doc"))


@queries.add(
    "decimal_decode_wide",
    """SELECT p_partkey, '1329227995784915872903807060280344576.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS text FROM part""",
)
def decimal_decode_wide(spark, sf):
    """More than 15 bytes: 2^120 · 100 + n, with two decimals."""
    # 2^120 * 100 in hex is 64 followed by 30 zeros; n fits into the last byte.
    body = F.concat(F.lit("0064" + "00" * 14), F.lpad(F.hex(F.col("p_partkey") % 100), 2, "0"))
    doc = F.concat(F.lit('{"scale":2,"value":"'), F.base64(F.unhex(body)), F.lit('"}'))
    return table(spark, sf, "part").select("p_partkey", deep.decode_decimal(doc).alias("text"))


@queries.add(
    "relative_age",
    """WITH a AS (SELECT event_id, 1705363200000000 - epoch_us(ts) AS d FROM events),
s AS (SELECT event_id, d, abs(d) // 1000000 AS n FROM a)
SELECT event_id, CASE WHEN d <= -1000000 THEN 'in ' ELSE '' END || CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN n // 60 || 'm'
  WHEN n < 86400 THEN n // 3600 || 'h' ELSE n // 86400 || 'd' END || CASE WHEN d <= -1000000 THEN '' ELSE ' ago' END AS age FROM s""",
)
def relative_age(spark, sf):
    return events(spark, sf).select(
        "event_id", present.relative_age(F.col("ts"), F.lit(NOW)).alias("age")
    )


@queries.add(
    "truncated_texts",
    """SELECT doc_id, CASE WHEN length(text) <= 64 THEN text ELSE left(text, 63) || '...' END AS short FROM documents""",
)
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", present.truncated(F.col("text")).alias("short"))


@queries.add(
    "operation_labels",
    CDC
    + """SELECT CASE WHEN event_id % 4 = 0 THEN '~ UPDATE' WHEN event_id % 4 = 1 THEN 'merge' ELSE
  CASE operation WHEN 'INSERT' THEN '+ ' WHEN 'UPDATE' THEN '~ ' ELSE '- ' END || operation END AS label, count(*) AS n
FROM c GROUP BY 1""",
)
def operation_labels(spark, sf):
    """Case does not matter; a missing operation is an update, an unknown one stays."""
    operation = F.expr(
        """CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'merge'
        ELSE CASE op WHEN 'd' THEN 'delete' WHEN 'u' THEN 'Update' ELSE 'INSERT' END END"""
    )
    return (
        events(spark, sf)
        .select(present.operation_label(operation).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@queries.add(
    "table_labels",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'svc.t' WHEN 1 THEN 't' WHEN 2 THEN 'svc' ELSE 'unknown' END AS label FROM supplier""",
)
def table_labels(spark, sf):
    service = F.expr("CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'svc' END")
    name = F.expr("CASE WHEN s_suppkey % 4 IN (0, 1) THEN 't' END")
    return table(spark, sf, "supplier").select(
        "s_suppkey", present.table_label(service, name).alias("label")
    )
