"""Column-level change history and the questions asked of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.functions import origin
from changetide.functions import values as V
from changetide.operators import ordered
from changetide.operators.ingest import envelope_rows
from changetide.schemas import POSITION_ORDER
from changetide.sources import keyed

LATEST = ("changed_at", *POSITION_ORDER)


def column_deltas(events: DataFrame, unwrap_envelope: bool = True) -> DataFrame:
    """One row per changed column of each event, without a shuffle.

    An INSERT has no old row, a DELETE no new one; JSON null equals an absent key.
    """
    rows = envelope_rows(
        events.where(F.col("table_id").isNotNull() & F.col("event_data").isNotNull()),
        unwrap_envelope,
    )
    none = F.create_map().cast("map<string,string>")
    texts = rows.withColumns(
        {
            "_old": F.when(
                F.col("operation") != "INSERT",
                F.coalesce(V.canonical_values(F.col("before_row")), none),
            ).otherwise(none),
            "_new": F.when(
                F.col("operation") != "DELETE",
                F.coalesce(V.canonical_values(F.col("after_row")), none),
            ).otherwise(none),
        }
    )
    deltas = F.filter(
        F.transform(
            F.array_union(F.map_keys("_old"), F.map_keys("_new")),
            lambda k: F.struct(
                k.alias("column_name"),
                V.sql_null(F.try_element_at("_old", k)).alias("old_value"),
                V.sql_null(F.try_element_at("_new", k)).alias("new_value"),
            ),
        ),
        lambda d: ~V.same_value(d["old_value"], d["new_value"]),
    )
    return texts.select(
        "topic",
        "partition",
        "offset",
        "table_id",
        "operation",
        "row_identity",
        F.col("event_time").alias("changed_at"),
        F.inline(deltas),
    )


def column_changes(
    events: DataFrame, columns: DataFrame, unwrap_envelope: bool = True
) -> DataFrame:
    """Deltas of audited catalog columns.

    The catalog is broadcast: it has a row per table and column, however many events there are. Spark
    takes rows that came out of a document for far smaller than they are, and would send the deltas.
    """
    audited = columns.where("audit_enabled").select("table_id", "column_id", "column_name")
    return column_deltas(events, unwrap_envelope).join(F.broadcast(audited), ["table_id", "column_name"])


def history(
    changes: DataFrame,
    *,
    table_id: int | None = None,
    column_name: str | None = None,
    row_identity: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Filter changes; bounds are inclusive. ``row_identity`` is JSON in any key order."""
    out = changes
    if table_id is not None:
        out = out.where(F.col("table_id") == table_id)
    if column_name is not None:
        out = out.where(F.col("column_name") == column_name)
    if row_identity is not None:
        out = out.where(F.col("row_identity") == F.to_json(F.parse_json(F.lit(row_identity))))
    if start is not None:
        out = out.where(F.col("changed_at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("changed_at") <= F.lit(end))
    return prune_months(out, start, end)


def prune_months(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Repeat time bounds on the ``month`` partition column, when the table has one."""
    if "month" not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col("month") >= F.date_format(F.lit(start), "yyyyMM"))
    if end is not None:
        df = df.where(F.col("month") <= F.date_format(F.lit(end), "yyyyMM"))
    return df


def name_columns(changes: DataFrame, columns: DataFrame) -> DataFrame:
    """Attach names to changes stored with column ids only; the catalog is the side that is broadcast."""
    names = columns.select("table_id", "column_id", "column_name")
    return changes.drop("column_name").join(F.broadcast(names), ["table_id", "column_id"])


def value_at(
    changes: DataFrame,
    tables: DataFrame,
    service_name: str,
    table_name: str,
    column_name: str,
    at: datetime,
    database_name: str | None = None,
) -> DataFrame:
    """Latest change of a column at a time, over all rows of the table.

    One row per matching database. ``found`` tells "set to null" from "no history".
    """
    wanted = tables.where(
        (F.col("service_name") == service_name) & (F.col("table_name") == table_name) & F.col("is_active")
    )
    if database_name is not None:
        wanted = wanted.where(F.col("database_name") == database_name)
    past = prune_months(
        changes.where((F.col("column_name") == column_name) & (F.col("changed_at") <= F.lit(at))),
        None,
        at,
    )
    latest = (
        past.join(wanted.select("table_id"), "table_id", "left_semi")
        .groupBy("table_id")
        .agg(F.max_by(F.struct("new_value", "changed_at"), F.struct(*LATEST)).alias("hit"))
    )
    return wanted.select("table_id", "database_name").join(latest, "table_id", "left").select(
        "database_name",
        F.col("hit.new_value").alias("value"),
        F.col("hit.changed_at").alias("changed_at"),
        F.col("hit").isNotNull().alias("found"),
    )


def values_at(
    changes: DataFrame,
    lookups: DataFrame,
    keys: tuple[str, ...] = ("table_id", "column_name", "row_identity"),
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """As-of values for a table of (keys…, at) lookups.

    Changes and lookups are merged and the latest change carried forward, so a lookup is never
    paired with more than the one change it asks for, and hot keys are cut into time slices.
    """
    facts = changes.select(
        *keys,
        F.unix_micros("changed_at").alias("_at"),
        *POSITION_ORDER,
        F.struct("new_value", "changed_at").alias("_hit"),
    )
    # Any number of lookups may ask for one key at one instant; one of them is carried.
    asks = lookups.select(*keys, F.unix_micros("at").alias("_at")).distinct().select(
        *keys,
        "_at",
        # After every change of the same instant.
        F.lit(2**62).alias("offset"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("string").alias("topic"),
        F.lit(None).cast(facts.schema["_hit"].dataType).alias("_hit"),
        F.lit(True).alias("_ask"),
    )
    facts = facts.withColumn("_ask", F.lit(False))
    carried = ordered.carry_last(
        facts.unionByName(asks), keys, "_at", F.col("_hit"), "_found", POSITION_ORDER, slicing=slicing
    )
    answers = carried.where("_ask").select(*keys, "_at", "_found")
    timed = lookups.withColumn("_at", F.unix_micros("at"))
    return ordered.attach(timed, answers, [*keys, "_at"]).select(
        *lookups.columns,
        F.col("_found.new_value").alias("value"),
        F.col("_found.changed_at").alias("changed_at"),
        F.col("_found").isNotNull().alias("found"),
    )


STATE_KEY = ("table_id", "row_identity")
STATE_ORDER = ("event_time", *POSITION_ORDER)


def merge_state(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Row states with those of a batch merged in, both with positions and deleted rows; the later one stays."""
    return keyed.newest(stored, batch, STATE_KEY, STATE_ORDER)


def current_state(events: DataFrame, keep_deleted: bool = False, positions: bool = False) -> DataFrame:
    """Latest row image per row identity, by event order and not by arrival.

    ``max_by`` keeps one candidate per key and task, so a hot row never gathers in one place. With
    ``positions``, each image tells where it comes from, so that states can be merged.
    """
    rows = envelope_rows(events.where(F.col("row_identity").isNotNull()))
    order = F.struct("event_time", *POSITION_ORDER)
    last = (
        rows.select(
            "table_id",
            "row_identity",
            order.alias("o"),
            F.struct(
                "operation",
                "event_time",
                V.canonical_json(F.col("after_row")).alias("row"),
                *(POSITION_ORDER if positions else ()),
            ).alias("image"),
        )
        .groupBy("table_id", "row_identity")
        .agg(F.max_by("image", "o").alias("image"))
        .select("table_id", "row_identity", "image.*")
    )
    return last if keep_deleted else last.where(F.col("operation") != "DELETE")


def change_response(changes: DataFrame) -> DataFrame:
    """Columns a history query returns."""
    return changes.select(
        "topic",
        "partition",
        "offset",
        "column_name",
        "operation",
        "row_identity",
        "old_value",
        "new_value",
        "changed_at",
    )


def field_timeline(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events joined to the column changes they caused."""
    position = ["topic", "partition", "offset"]
    kept = changes.select(*position, "column_name", "old_value", "new_value")
    return events.join(kept, position)


def table_of(service_name: str, database_name: str, table_name: str) -> int:
    """The id a table gets, computed once on the driver's side of the plan."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    expression = origin.table_id(F.lit(service_name), F.lit(database_name), F.lit(table_name))
    return spark.range(1).select(expression).head()[0]
