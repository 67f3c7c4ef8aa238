"""Schema discovery, catalog merges, drift and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from changetide.functions import values
from changetide.operators import catalog, ingest, search
from changetide.session import work_folder
from changetide.sources import keyed
from workload.samples import CDC, TYPES, Registry, events, parsed, table

queries = Registry()


@queries.add(
    "discover_tables",
    CDC
    + """SELECT DISTINCT 'eventdb' AS service_name, 'analytics' AS database_name,
  'public.' || event_type AS table_name, topic AS topic_name, true AS is_active FROM g""",
)
def discover_tables(spark, sf):
    return catalog.discover_tables(parsed(spark, sf)).drop("table_id")


@queries.add(
    "infer_columns",
    CDC
    + """SELECT col AS column_name, is_nullable, count(*) AS n FROM (
  SELECT col, (col = 'k' AND has_before AND event_id % 5 = 0) AS is_nullable
  FROM g, (VALUES ('id'), ('event_type'), ('value'), ('k')) AS t(col)) GROUP BY ALL""",
)
def infer_columns(spark, sf):
    """Columns inferred per event from its row versions."""
    described = catalog.event_columns(parsed(spark, sf))
    return described.groupBy("column_name", "is_nullable").agg(F.count(F.lit(1)).alias("n"))


@queries.add(
    "inferred_types",
    CDC
    + """SELECT col AS column_name, typ AS data_type, count(*) AS n FROM (
  SELECT 'id' AS col, 'integer' AS typ FROM g UNION ALL SELECT 'event_type', 'string' FROM g
  UNION ALL SELECT 'value', 'number' FROM g
  UNION ALL SELECT 'k', CASE WHEN op = 'd' AND event_id % 5 = 0 THEN 'unknown' ELSE 'integer' END FROM g) GROUP BY ALL""",
)
def inferred_types(spark, sf):
    """Type names by the first sample that is not null."""
    described = catalog.event_columns(parsed(spark, sf))
    return described.groupBy("column_name", "data_type").agg(F.count(F.lit(1)).alias("n"))


@queries.add(
    "merge_columns",
    CDC
    + """, first AS (SELECT event_type, arg_min(struct_pack(op := op, id := event_id, hb := has_before), (ms, event_id)) AS f
  FROM g GROUP BY event_type)
SELECT 'public.' || event_type AS table_name, col AS column_name,
  CASE WHEN col = 'k' AND f.op = 'd' AND f.id % 5 = 0 THEN 'unknown' ELSE typ END AS data_type,
  (col = 'k' AND f.hb AND f.id % 5 = 0) AS is_nullable, true AS audit_enabled
FROM first, (VALUES ('id', 'integer'), ('event_type', 'string'), ('value', 'number'), ('k', 'integer')) AS t(col, typ)""",
)
def merge_columns(spark, sf):
    """One definition per table and column; the earliest event decides."""
    rows = parsed(spark, sf)
    return (
        catalog.discover_columns(rows)
        .join(catalog.discover_tables(rows), "table_id")
        .select("table_name", "column_name", "data_type", "is_nullable", "audit_enabled")
    )


def _declared(spark, sf):
    """Orders as events whose schema envelope declares types and keys."""
    field = lambda name, kind, key, optional: F.struct(
        F.lit(name).alias("field"),
        F.lit(kind).alias("type"),
        F.lit(key).alias("primaryKey"),
        F.lit(optional).alias("optional"),
    )
    rows = F.array(
        field("o_orderkey", "int64", True, False),
        field("o_totalprice", "double", False, True),
        field("__deleted", "string", False, True),
    )
    schema = F.struct(
        F.lit("struct").alias("type"),
        F.array(
            F.struct(F.lit("before").alias("field"), rows.alias("fields")),
            F.struct(F.lit("after").alias("field"), rows.alias("fields")),
        ).alias("fields"),
    )
    payload = F.struct(
        F.struct("o_orderkey", "o_totalprice").alias("after"),
        F.struct(
            F.lit("orderdb").alias("name"),
            F.lit("shop").alias("db"),
            F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("table"),
        ).alias("source"),
        F.lit("r").alias("op"),
        F.expr("unix_millis(cast(o_orderdate as timestamp))").alias("ts_ms"),
    )
    landed = table(spark, sf, "orders").select(
        F.lit("orderdb.shop.orders").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(schema.alias("schema"), payload.alias("payload"))).alias("value"),
    )
    return ingest.parse_messages(landed)


@queries.add(
    "declared_columns",
    """SELECT table_name, column_name, data_type, pk AS is_primary_key, opt AS is_nullable, n
FROM (SELECT 'orders_' || lower(o_orderstatus) AS table_name, count(*) AS n FROM orders GROUP BY 1),
  (VALUES ('o_orderkey', 'int64', true, false), ('o_totalprice', 'double', false, true)) AS t(column_name, data_type, pk, opt)""",
)
def declared_columns(spark, sf):
    """Columns taken from the schema envelope."""
    rows = _declared(spark, sf)
    described = catalog.event_columns(rows)
    names = catalog.discover_tables(rows).select("table_id", "table_name")
    return (
        described.join(names, "table_id")
        .groupBy("table_name", "column_name", "data_type", "is_primary_key", "is_nullable")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@queries.add(
    "identity_from_catalog",
    """SELECT o_orderkey AS "offset", '{"o_orderkey":' || o_orderkey || '}' AS row_identity FROM orders""",
)
def identity_from_catalog(spark, sf):
    """Row identity from keys the catalog declares."""
    rows = _declared(spark, sf)
    keyed = catalog.attach_key_columns(rows, catalog.discover_columns(rows))
    return ingest.with_row_identity(keyed, "key_columns").select("offset", "row_identity")


_OLD_TABLES = """
old AS (SELECT 'eventdb' AS service_name, 'analytics' AS database_name, 'public.' || event_type AS table_name,
  'old.topic' AS topic_name, false AS is_active FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type
  UNION ALL SELECT 'eventdb', 'archive', 'public.gone', 'old.topic', true)"""


def _old_tables(spark, sf):
    found = catalog.discover_tables(parsed(spark, sf))
    known = found.where(F.col("table_name").isin("public.view", "public.click")).withColumns(
        {"topic_name": F.lit("old.topic"), "is_active": F.lit(False)}
    )
    gone = events(spark, sf).select(
        F.lit(-1).cast("bigint").alias("table_id"),
        F.lit("eventdb").alias("service_name"),
        F.lit("archive").alias("database_name"),
        F.lit("public.gone").alias("table_name"),
        F.lit("old.topic").alias("topic_name"),
        F.lit(True).alias("is_active"),
    ).distinct()
    return known.unionByName(gone), found


@queries.add(
    "upsert_tables",
    CDC
    + ","
    + _OLD_TABLES
    + """, new AS (SELECT DISTINCT 'eventdb' AS service_name, 'analytics' AS database_name,
  'public.' || event_type AS table_name, topic AS topic_name, true AS is_active FROM g)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE table_name NOT IN (SELECT table_name FROM new)""",
)
def upsert_tables(spark, sf):
    """Known tables get the new topic and become active; unseen ones stay."""
    known, found = _old_tables(spark, sf)
    return catalog.upsert_tables(known, found).drop("table_id")


@queries.add(
    "upsert_columns",
    CDC
    + """SELECT 'public.' || event_type AS table_name, col AS column_name, typ AS data_type, col <> 'id' AS audit_enabled
FROM (SELECT DISTINCT event_type FROM g), (VALUES ('id', 'integer'), ('event_type', 'string'), ('value', 'number'), ('old', 'text')) AS t(col, typ)""",
)
def upsert_columns(spark, sf):
    """Types are refreshed, the audit switch is not, unseen columns stay."""
    rows = parsed(spark, sf)
    found = catalog.discover_columns(rows).where("column_name <> 'k'").persist()  # small, and used three times
    known = found.where("column_name = 'id'").withColumns(
        {"data_type": F.lit("text"), "audit_enabled": F.lit(False)}
    ).unionByName(
        found.where("column_name = 'id'").withColumns(
            {"column_name": F.lit("old"), "data_type": F.lit("text"), "audit_enabled": F.lit(True)}
        )
    )
    names = catalog.discover_tables(rows).select("table_id", "table_name")
    return catalog.upsert_columns(known, found).join(names, "table_id").select(
        "table_name", "column_name", "data_type", "audit_enabled"
    )


@queries.add(
    "upsert_columns_stored",
    CDC
    + """SELECT 'public.' || event_type AS table_name, col AS column_name, typ AS data_type, col <> 'id' AS audit_enabled
FROM (SELECT DISTINCT event_type FROM g), (VALUES ('id', 'integer'), ('event_type', 'string'), ('value', 'number'), ('old', 'text')) AS t(col, typ)""",
)
def upsert_columns_stored(spark, sf):
    """The same on a table stored by key, which stays where it is."""
    rows = parsed(spark, sf)
    found = catalog.discover_columns(rows).where("column_name <> 'k'").persist()  # small, and used three times
    known = found.where("column_name = 'id'").withColumns({"data_type": F.lit("text"), "audit_enabled": F.lit(False)})
    old = known.withColumns({"column_name": F.lit("old"), "audit_enabled": F.lit(True)})
    name = f"{keyed.database(spark, work_folder(spark))}.columns"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ("table_id", "column_name")
    for batch in (known.unionByName(old), found):
        keyed.merge(spark, name, batch, key, buckets, catalog.upsert_columns)
    names = catalog.discover_tables(rows).select("table_id", "table_name")
    return spark.table(name).join(names, "table_id").select("table_name", "column_name", "data_type", "audit_enabled")


@queries.add(
    "tables_with_columns",
    CDC
    + """SELECT 'public.' || event_type AS table_name, 'event_type,id,k,value' AS columns FROM g GROUP BY event_type""",
)
def tables_with_columns(spark, sf):
    rows = parsed(spark, sf)
    nested = catalog.tables_with_columns(catalog.discover_tables(rows), catalog.discover_columns(rows))
    return nested.select(
        "table_name", F.array_join(F.col("columns.column_name"), ",").alias("columns")
    )


@queries.add(
    "catalog_counts",
    CDC
    + """SELECT 'tables' AS what, count(DISTINCT event_type) AS n FROM g
UNION ALL SELECT 'columns', 4 * count(DISTINCT event_type) FROM g""",
)
def catalog_counts(spark, sf):
    rows = parsed(spark, sf)
    return catalog.catalog_counts(catalog.discover_tables(rows), catalog.discover_columns(rows))


@queries.add(
    "tables_by_service",
    CDC
    + """SELECT 'eventdb' AS service_name, string_agg(DISTINCT 'public.' || event_type, ',' ORDER BY 'public.' || event_type) AS tables FROM g""",
)
def tables_by_service(spark, sf):
    grouped = catalog.tables_by_service(catalog.discover_tables(parsed(spark, sf)))
    return grouped.select("service_name", F.array_join("tables", ",").alias("tables"))


@queries.add(
    "events_with_table_names",
    CDC
    + """SELECT event_id AS "offset", 'eventdb' AS known_service, 'public.' || event_type AS known_table FROM g""",
)
def events_with_table_names(spark, sf):
    rows = parsed(spark, sf).where(F.col("table_id").isNotNull())
    named = catalog.attach_tables(rows, catalog.discover_tables(rows))
    return named.select("offset", "known_service", "known_table")


def _listing(spark, sf):
    """Expected and actual columns, derived from the parts table."""
    parts = table(spark, sf, "part")
    base = parts.select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string")).alias("table_name"),
        F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("column_name"),
        F.col("p_size").alias("s"),
        (F.col("p_partkey") % 40).alias("t"),
    ).distinct()
    expected = base.where("t <> 7").select(
        "table_name",
        "column_name",
        F.expr("CASE WHEN s % 2 = 0 THEN 'integer' ELSE 'text' END").alias("data_type"),
        F.expr("s % 3 = 0").alias("nullable"),
    )
    actual = base.where("t <> 3 AND s <> 11").select(
        "table_name",
        "column_name",
        F.expr("CASE WHEN s % 2 = 0 THEN 'bigint' WHEN s = 13 THEN 'json' ELSE 'text' END").alias("data_type"),
        F.expr("s % 3 = 0 OR s = 17").alias("nullable"),
    )
    return expected, actual


@queries.add(
    "schema_drift",
    """WITH b AS (SELECT DISTINCT 't' || (p_partkey % 40) AS table_name, 'c' || p_size AS column_name, p_size AS s,
  p_partkey % 40 AS t FROM part)
SELECT DISTINCT table_name, NULL AS column_name, 'Missing table: ' || table_name AS issue FROM b WHERE t = 3
UNION ALL SELECT DISTINCT table_name, NULL, 'Unexpected table: ' || table_name FROM b WHERE t = 7 AND s <> 11
UNION ALL SELECT table_name, column_name, 'Missing column: ' || table_name || '.' || column_name FROM b WHERE t NOT IN (3, 7) AND s = 11
UNION ALL SELECT table_name, column_name, 'Type mismatch: ' || table_name || '.' || column_name || ': expected text, got json'
  FROM b WHERE t NOT IN (3, 7) AND s = 13
UNION ALL SELECT table_name, column_name, 'Nullable mismatch: ' || table_name || '.' || column_name || ': expected nullable=False, got nullable=True'
  FROM b WHERE t NOT IN (3, 7) AND s = 17""",
)
def schema_drift(spark, sf):
    return catalog.schema_drift(*_listing(spark, sf))


@queries.add(
    "manifest_coverage",
    CDC
    + """, w AS (SELECT DISTINCT 'eventdb.public.' || lower(p_type) AS topic FROM part
  UNION SELECT 'eventdb.public.' || t FROM (VALUES ('click'), ('view')) AS v(t)),
s AS (SELECT DISTINCT topic FROM g)
SELECT coalesce(w.topic, s.topic) AS topic,
  CASE WHEN s.topic IS NULL THEN 'missing' WHEN w.topic IS NULL THEN 'unexpected' ELSE 'covered' END AS status
FROM w FULL JOIN s ON w.topic = s.topic""",
)
def manifest_coverage(spark, sf):
    wanted = (
        table(spark, sf, "part")
        .select(F.concat(F.lit("eventdb.public."), F.lower("p_type")).alias("topic"))
        .unionByName(
            events(spark, sf)
            .where(F.col("event_type").isin(*TYPES[:1], *TYPES[-1:]))
            .select(F.concat(F.lit("eventdb.public."), "event_type").alias("topic"))
        )
    )
    return catalog.manifest_coverage(wanted, catalog.discover_tables(parsed(spark, sf)))


@queries.add(
    "reference_tables",
    """SELECT s_suppkey AS id, 'svc' || s_nationkey AS service, 'public.t' || s_suppkey AS "table" FROM supplier""",
)
def reference_tables(spark, sf):
    """``service.table`` references split at the first dot."""
    ref = F.concat(F.lit(" svc"), "s_nationkey", F.lit(".public.t"), "s_suppkey")
    found = search.reference_parts(ref)
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), found["service"].alias("service"), found["table"].alias("table")
    )


@queries.add(
    "canonical_json",
    """SELECT o_orderkey AS id, '{"a":{"x":' || o_custkey || ',"y":[1,null]},"b":"' || o_orderstatus || '"}' AS doc FROM orders""",
)
def canonical_json(spark, sf):
    """Canonical text sorts keys at every level and has no blanks."""
    raw = F.concat(
        F.lit('{ "b" : "'), "o_orderstatus", F.lit('", "a": {"y":[1, null], "x": '), "o_custkey", F.lit("}}")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_json(values.parse_json(raw)).alias("doc")
    )
