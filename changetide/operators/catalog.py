"""Schema discovery: which tables and columns the events describe, and catalog upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.functions import origin, parsing
from changetide.functions import values as V
from changetide.operators.ingest import envelope_rows
from changetide.schemas import TABLE_KEY

# Type names that a drift check treats as the same.
INTEGER_TYPES = ("integer", "bigint", "smallint")
IGNORED_TABLES = ("schema_migrations", "spatial_ref_sys", "geography_columns", "geometry_columns")


def discover_tables(events: DataFrame) -> DataFrame:
    """Distinct source tables; the topic of the latest event wins."""
    keys = ("table_id", "catalog_service", "database_name", "table_name")
    # First down to one row per table and topic, by hashing; the rest is tiny.
    per_topic = (
        events.where(F.col("table_id").isNotNull())
        .groupBy(*keys, "topic")
        .agg(F.max(origin.order_key(F.col("capture_time"), F.col("offset"))).alias("last"))
    )
    return (
        per_topic.groupBy(*keys)
        .agg(F.max_by("topic", F.struct("last", "topic")).alias("topic_name"))
        .select(
            "table_id",
            F.col("catalog_service").alias("service_name"),
            "database_name",
            "table_name",
            "topic_name",
            F.lit(True).alias("is_active"),
        )
    )


def _truthy(v: Column, default: bool) -> Column:
    """Python truth of a VARIANT; an absent value takes the default."""
    doc = F.to_json(v)
    return F.when(doc.isNull(), F.lit(default)).otherwise(~doc.isin(*V.EMPTY_JSON))


def _nonblank(v: Column) -> Column:
    doc = F.to_json(v)
    return F.when(~doc.isin(*V.EMPTY_JSON), F.try_variant_get(v, "$", "string"))


def _type_name(v: Column) -> Column:
    """Type as text; an object type is known by its name, else its type."""
    return F.coalesce(
        F.when(
            F.try_variant_get(v, "$", V.ROW_TYPE).isNotNull(),
            F.coalesce(V.given_text(v, "name"), V.given_text(v, "type"), F.lit("unknown")),
        ),
        _nonblank(v),
    )


def _field_list(fields: Column) -> Column:
    """``fields`` given as a list, or as an object keyed by field name."""
    listed = F.filter(
        F.try_variant_get(fields, "$", "array<variant>"),
        lambda x: F.try_variant_get(x, "$", V.ROW_TYPE).isNotNull(),
    )
    keyed = F.filter(
        F.map_entries(F.try_variant_get(fields, "$", V.ROW_TYPE)),
        lambda e: F.try_variant_get(e["value"], "$", V.ROW_TYPE).isNotNull(),
    )
    as_struct = lambda x, name: F.struct(
        name.alias("field"),
        x.alias("definition"),
        F.try_variant_get(x, "$.fields", "array<variant>").isNotNull().alias("nested"),
    )
    return F.coalesce(
        F.transform(
            listed,
            lambda x: as_struct(x, F.coalesce(V.given_text(x, "field"), V.given_text(x, "name"))),
        ),
        F.transform(
            keyed, lambda e: as_struct(e["value"], F.coalesce(V.given_text(e["value"], "field"), e["key"]))
        ),
    )


def _declared_columns(fields: Column) -> Column:
    """Columns of the first row container among the fields, else the fields themselves."""
    usable = F.filter(fields, lambda f: f["field"].isNotNull() & ~f["field"].startswith("__"))
    return F.transform(
        usable,
        lambda f: F.struct(
            f["field"].alias("column_name"),
            F.coalesce(
                _type_name(V.member(f["definition"], "type")),
                V.given_text(f["definition"], "name"),
                F.lit("unknown"),
            ).alias("data_type"),
            _truthy(V.member(f["definition"], "primaryKey"), False).alias("is_primary_key"),
            _truthy(V.member(f["definition"], "optional"), True).alias("is_nullable"),
        ),
    )


def with_declared_columns(events: DataFrame) -> DataFrame:
    """Add ``declared``: column definitions taken from the schema envelope, NULL without one."""
    data = F.col("event_data")
    outer, inner = V.rare_member(data, "schema"), V.rare_member(parsing.payload_of(data), "schema")
    found = F.coalesce(F.when(V.is_object(outer), outer), F.when(V.is_object(inner), inner))
    # Looked for once: most events carry no schema, and all that follows asks for it.
    staged = V.computed(events, _schema=found)
    schema = F.col("_schema")
    staged = staged.withColumn("_fields", _field_list(V.member(schema, "fields")))
    container = F.try_element_at(
        F.filter("_fields", lambda f: f["field"].isin("after", "before") & f["nested"]), F.lit(1)
    )
    # An object-shaped list prefers after over before, whatever its key order.
    preferred = F.coalesce(
        F.when(
            V.as_row(schema, "fields").isNotNull(),
            F.try_element_at(
                F.filter("_fields", lambda f: (f["field"] == "after") & f["nested"]), F.lit(1)
            ),
        ),
        container,
    )
    inner = _field_list(V.member(preferred["definition"], "fields"))
    staged = staged.withColumn("_row_fields", F.coalesce(inner, F.col("_fields")))
    declared = _declared_columns(F.col("_row_fields"))
    return staged.withColumn("declared", F.when(F.size(declared) > 0, declared)).drop(
        "_schema", "_fields", "_row_fields"
    )


def infer_columns(before: Column, after: Column) -> Column:
    """Column definitions from row versions: first non-null sample gives the type."""
    none = F.array().cast("array<string>")
    names = F.filter(
        F.array_union(F.coalesce(F.map_keys(after), none), F.coalesce(F.map_keys(before), none)),
        lambda k: ~k.startswith("__"),
    )

    # Each value is looked up once: a lookup copies the value out of its row.
    values = F.transform(
        names,
        lambda k: F.struct(
            k.alias("name"), F.try_element_at(after, k).alias("new"), F.try_element_at(before, k).alias("old")
        ),
    )

    def null(value: Column) -> Column:
        return F.coalesce(F.is_variant_null(value), F.lit(False))

    def sample(new: Column, old: Column) -> Column:
        return F.when(new.isNotNull() & ~F.is_variant_null(new), new).when(
            old.isNotNull() & ~F.is_variant_null(old), old
        )

    return F.transform(
        values,
        lambda v: F.struct(
            v["name"].alias("column_name"),
            V.json_kind(sample(v["new"], v["old"])).alias("data_type"),
            F.lit(False).alias("is_primary_key"),
            (null(v["old"]) | null(v["new"])).alias("is_nullable"),
        ),
    )


def event_columns(events: DataFrame) -> DataFrame:
    """One row per event and described column; a schema envelope beats inference."""
    rows = with_declared_columns(envelope_rows(events.where(F.col("table_id").isNotNull())))
    definitions = F.coalesce(
        F.col("declared"), infer_columns(F.col("before_row"), F.col("after_row"))
    )
    return rows.select("table_id", "capture_time", "offset", F.inline(definitions))


def merge_columns(described: DataFrame) -> DataFrame:
    """Catalog columns; the first definition of a column wins."""
    parts = ("data_type", "is_primary_key", "is_nullable")
    # First down to the distinct definitions, by hashing; the rest is tiny.
    distinct = described.groupBy("table_id", "column_name", *parts).agg(
        F.min(origin.order_key(F.col("capture_time"), F.col("offset"))).alias("first")
    )
    return (
        distinct.groupBy("table_id", "column_name")
        .agg(F.min_by(F.struct(*parts), F.struct("first", *parts)).alias("d"))
        .select(
            "table_id",
            origin.column_id(F.col("table_id"), F.col("column_name")).alias("column_id"),
            "column_name",
            "d.data_type",
            "d.is_primary_key",
            "d.is_nullable",
            F.lit(True).alias("audit_enabled"),
        )
    )


def discover_columns(events: DataFrame) -> DataFrame:
    return merge_columns(event_columns(events))


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    kept: Sequence[str] = (),
    touched_only: bool = False,
) -> DataFrame:
    """Merge by key: incoming values replace existing ones, except the ``kept`` columns.

    Both inputs hold one row per key. ``touched_only`` leaves out the rows whose key does not come in.
    """
    how = "right_outer" if touched_only else "full_outer"
    both = (
        existing.select(F.struct(*existing.columns).alias("old"), *keys)
        .join(incoming.select(F.struct(*existing.columns).alias("new"), *keys), list(keys), how)
    )

    def pick(name: str) -> Column:
        if name in kept:
            chosen = F.when(F.col("old").isNotNull(), F.col("old")[name]).otherwise(F.col("new")[name])
        else:
            chosen = F.when(F.col("new").isNotNull(), F.col("new")[name]).otherwise(F.col("old")[name])
        return chosen.alias(name)

    return both.select(*(pick(name) for name in existing.columns))


def upsert_tables(existing: DataFrame, discovered: DataFrame, touched_only: bool = False) -> DataFrame:
    """Refresh topic, reactivate; the id of a known table stays."""
    return upsert(existing, discovered, TABLE_KEY, ("table_id",), touched_only)


def upsert_columns(existing: DataFrame, discovered: DataFrame, touched_only: bool = False) -> DataFrame:
    """Refresh type, key and nullability; an audit switch set by a person stays."""
    return upsert(existing, discovered, ("table_id", "column_name"), ("column_id", "audit_enabled"), touched_only)


def active_tables(tables: DataFrame, tenant: str | None = None) -> DataFrame:
    found = tables.where("is_active")
    return found.where(F.col("service_name") == tenant) if tenant else found


def columns_by_name(columns: DataFrame) -> DataFrame:
    return columns.orderBy("table_id", "column_name")


def tables_with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Each table with its columns nested, in name order."""
    nested = columns.groupBy("table_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("column_name", "data_type", "is_primary_key", "is_nullable", "audit_enabled")
            )
        ).alias("columns")
    )
    return tables.join(nested, "table_id", "left")


def catalog_counts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Number of active tables and of their columns."""
    live = active_tables(tables)
    counts = live.agg(F.count(F.lit(1)).alias("n")).select(F.lit("tables").alias("what"), "n")
    inner = columns.join(live.select("table_id"), "table_id", "left_semi")
    return counts.unionByName(
        inner.agg(F.count(F.lit(1)).alias("n")).select(F.lit("columns").alias("what"), "n")
    )


def tables_by_service(tables: DataFrame) -> DataFrame:
    """Distinct table names per service, sorted."""
    return (
        tables.select("service_name", "table_name")
        .distinct()
        .groupBy("service_name")
        .agg(F.array_sort(F.collect_list("table_name")).alias("tables"))
    )


def key_columns(columns: DataFrame) -> DataFrame:
    """Declared key columns per table."""
    return (
        columns.where("is_primary_key")
        .groupBy("table_id")
        .agg(F.array_sort(F.collect_set("column_name")).alias("key_columns"))
    )


def attach_key_columns(events: DataFrame, columns: DataFrame) -> DataFrame:
    """Add ``key_columns`` to events; the catalog side is broadcast when measured small."""
    return events.join(key_columns(columns), "table_id", "left")


def attach_tables(events: DataFrame, tables: DataFrame) -> DataFrame:
    """Add the display names of the catalogued table."""
    names = tables.select(
        "table_id",
        F.col("service_name").alias("known_service"),
        F.col("table_name").alias("known_table"),
    )
    return events.join(names, "table_id", "left")


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between two (table_name, column_name, data_type, nullable) listings."""
    def tables(df: DataFrame) -> DataFrame:
        return df.select("table_name").distinct()

    missing = tables(expected).join(tables(actual), "table_name", "left_anti").select(
        "table_name",
        F.lit(None).cast("string").alias("column_name"),
        F.concat(F.lit("Missing table: "), "table_name").alias("issue"),
    )
    unexpected = (
        tables(actual)
        .where(~F.col("table_name").isin(*IGNORED_TABLES))
        .join(tables(expected), "table_name", "left_anti")
        .select(
            "table_name",
            F.lit(None).cast("string").alias("column_name"),
            F.concat(F.lit("Unexpected table: "), "table_name").alias("issue"),
        )
    )
    wanted = expected.join(tables(actual), "table_name", "left_semi").select(
        "table_name", "column_name", F.struct("data_type", "nullable").alias("e")
    )
    found = actual.select("table_name", "column_name", F.struct("data_type", "nullable").alias("a"))
    pairs = wanted.join(found, ["table_name", "column_name"], "left")
    e, a = F.col("e"), F.col("a")
    label = F.concat(F.col("table_name"), F.lit("."), F.col("column_name"))
    compatible = (
        (e["data_type"] == a["data_type"])
        | ((e["data_type"] == "integer") & a["data_type"].isin(*INTEGER_TYPES))
        | ((e["data_type"] == "character varying") & a["data_type"].startswith("character varying"))
    )
    boolean = lambda c: F.when(c, "True").otherwise("False")
    issues = F.array_compact(
        F.array(
            F.when(a.isNull(), F.concat(F.lit("Missing column: "), label)),
            F.when(
                a.isNotNull() & ~compatible,
                F.concat(
                    F.lit("Type mismatch: "), label, F.lit(": expected "), e["data_type"],
                    F.lit(", got "), a["data_type"],
                ),
            ),
            F.when(
                a.isNotNull() & (e["nullable"] != a["nullable"]),
                F.concat(
                    F.lit("Nullable mismatch: "), label, F.lit(": expected nullable="),
                    boolean(e["nullable"]), F.lit(", got nullable="), boolean(a["nullable"]),
                ),
            ),
        )
    )
    columns = pairs.select("table_name", "column_name", F.explode(issues).alias("issue"))
    return missing.unionByName(unexpected).unionByName(columns)


def manifest_coverage(topics: DataFrame, tables: DataFrame) -> DataFrame:
    """Subscribed topics against the topics tables were discovered on."""
    wanted = topics.select("topic").distinct().withColumn("wanted", F.lit(True))
    seen = (
        tables.select(F.col("topic_name").alias("topic")).distinct().withColumn("seen", F.lit(True))
    )
    return wanted.join(seen, "topic", "full_outer").select(
        "topic",
        F.when(F.col("seen").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unexpected")
        .otherwise("covered")
        .alias("status"),
    )
