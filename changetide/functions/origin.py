"""Where an event came from: source table coordinates and broker positions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetide.functions import values as V


def coordinates(source: Mapping[str, Column]) -> dict[str, Column]:
    """Service, database, namespace and table of a source; all NULL without a table."""
    table = V.first_filled(source["table"], source["collection"])
    parts = {
        "source_service": V.first_filled(source["name"], source["server"]),
        "source_database": V.first_filled(source["db"], source["database"], source["catalog"]),
        "source_namespace": V.first_filled(source["schema"], source["schema_name"]),
        "source_table": table,
    }
    return {name: F.when(table.isNotNull(), part) for name, part in parts.items()}


def qualified_table(namespace: Column, table: Column) -> Column:
    """``namespace.table``, or the bare table without a namespace."""
    return F.when(table.isNotNull(), F.concat_ws(".", namespace, table))


def filter_names(database: Column, namespace: Column, table: Column) -> Column:
    """Names a table filter may use, plain and prefixed by the database."""
    qualified = qualified_table(namespace, table)
    names = F.array(
        table, qualified, F.concat(database, F.lit("."), table), F.concat(database, F.lit("."), qualified)
    )
    return F.when(table.isNotNull(), F.array_distinct(F.array_compact(names)))


def catalog_service(topic: Column, source_service: Column) -> Column:
    """Service under which a table is catalogued: topic prefix wins."""
    return F.coalesce(
        F.nullif(F.substring_index(topic, ".", 1), F.lit("")),
        source_service,
        F.lit("unknown"),
    )


def table_id(service: Column, database: Column, table: Column) -> Column:
    """Deterministic id, so that no lookup join is needed to assign it."""
    return F.when(table.isNotNull(), F.xxhash64(service, database, table))


def column_id(table: Column, column: Column) -> Column:
    return F.xxhash64(table, column)


def broker_location(kind: str, topic: Column, partition: Column, offset: Column) -> Column:
    """Broker-neutral position; the Kafka aliases are filled for Kafka only."""
    kafka = kind == "kafka"
    known = topic.isNotNull() & offset.isNotNull()
    if kafka:
        known = known & partition.isNotNull()
    return F.when(
        known,
        F.struct(
            F.lit(kind).alias("broker_kind"),
            topic.alias("broker_destination"),
            (partition.cast("string") if kafka else F.lit("")).alias("broker_substream"),
            offset.cast("string").alias("broker_position"),
            (topic if kafka else F.lit(None).cast("string")).alias("kafka_topic"),
            (partition.cast("int") if kafka else F.lit(None).cast("int")).alias("kafka_partition"),
            (offset.cast("bigint") if kafka else F.lit(None).cast("bigint")).alias("kafka_offset"),
        ),
    )


def message_position() -> Column:
    """Inverse of :func:`broker_location` over the dead-letter columns."""
    kafka = F.col("broker_kind") == "kafka"
    aliased = F.col("kafka_topic").isNotNull()
    return F.struct(
        F.coalesce(F.col("kafka_topic"), F.col("broker_destination")).alias("topic"),
        F.when(aliased, F.col("kafka_partition"))
        .when(kafka, F.col("broker_substream").try_cast("int"))
        .otherwise(F.lit(0))
        .alias("partition"),
        F.when(aliased, F.col("kafka_offset"))
        .otherwise(F.col("broker_position").try_cast("bigint"))
        .alias("offset"),
    )


def shown_substream(substream: Column) -> Column:
    """Blank substreams are shown as NULL."""
    return F.nullif(substream, F.lit(""))


def order_key(time: Column, offset: Column) -> Column:
    """Time, then offset, as one fixed-width number.

    Fixed-width buffers keep minimum and maximum in a hash aggregate; ordering by a struct would
    sort every input row first.
    """
    stretch = F.lit("10000000000000000000").cast("decimal(20,0)")
    micros = F.unix_micros(time).cast("decimal(18,0)")
    return (micros * stretch + F.coalesce(offset, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")
