"""The given tables seen as change events, row by row (no window, no shuffle).

``CDC`` is the same rule in SQL: e holds every event with its derived columns, m the messages that
have a value, g the ones whose value is a whole document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.functions import values
from changetide.operators import ingest
from changetide.session import configure
from changetide.sources.files import spread

TYPES = ("click", "error", "purchase", "signup", "view")


class Registry(dict):
    """Collects queries: ``@queries.add("name", sql)``."""

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(configure(spark), sf_dir)

            run.__name__ = name
            run.__doc__ = fn.__doc__
            self[name] = (run, sql)
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with UTC time, k from props and the kind of change."""
    return _shaped(table(spark, sf_dir, "events"))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.expr(
            "CASE WHEN event_id % 97 = 0 THEN 'd' WHEN event_id % 7 = 0 THEN 'c' "
            "WHEN event_id % 11 = 0 THEN 'r' ELSE 'u' END"
        ).alias("op"),
    )


def _before():
    return F.when(
        F.col("op").isin("u", "d"),
        F.struct(
            F.col("user_id").alias("id"),
            F.expr("CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END").alias("event_type"),
            F.expr("CASE WHEN event_id % 3 = 0 THEN value ELSE CAST(floor(value) AS DOUBLE) END").alias("value"),
            F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE k END").alias("k"),
        ),
    )


def _after():
    return F.when(F.col("op") != "d", F.struct(F.col("user_id").alias("id"), "event_type", "value", "k"))


def _source():
    return F.struct(
        F.lit("eventdb").alias("name"),
        F.lit("analytics").alias("db"),
        F.lit("public").alias("schema"),
        F.col("event_type").alias("table"),
    )


def document(nested: bool = False):
    """The change document of an event, flat or inside a ``payload``."""
    body = [
        _before().alias("before"),
        _after().alias("after"),
        _source().alias("source"),
        F.col("op").alias("op"),
        F.expr("unix_millis(ts)").alias("ts_ms"),
    ]
    extra = [
        F.col("user_id").alias("user_id"),
        F.expr("concat('t', user_id % 3)").alias("tenant"),
        F.struct(
            F.expr("concat('pw', user_id)").alias("password"),
            F.array(
                F.struct(F.expr("concat('tk', event_id)").alias("token"), F.col("k").alias("keep"))
            ).alias("items"),
        ).alias("meta"),
    ]
    fields = [*extra, F.struct(*body).alias("payload")] if nested else [*body, *extra]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def messages(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """Broker messages; some are tombstones, some are cut short."""
    doc = document(nested)
    value = F.when(F.col("event_id") % 103 == 0, F.lit(None)).when(
        F.col("event_id") % 101 == 0, F.left(doc, F.lit(5))
    ).otherwise(doc)
    # Dealt out as they are read: a table of one row group is read by one task, which should do nothing else.
    rows = _shaped(spread(table(spark, sf_dir, "events")))
    # Computed, or a filter for tombstones would print the documents in the scan already.
    return values.computed(rows, _value=F.encode(value, "UTF-8")).select(
        F.concat(F.lit("eventdb.public."), "event_type").alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.col("_value").alias("value"),
    )


def parsed(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    return ingest.parse_messages(ingest.skip_tombstones(messages(spark, sf_dir, nested)))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with their row identity."""
    return ingest.with_row_identity(ingest.filter_event_types(parsed(spark, sf_dir)))


def redelivered(df: DataFrame) -> DataFrame:
    """Every row, and every tenth position a second time."""
    return df.unionByName(df.where(F.col("offset") % 10 == 0))


def millis(name: str, alias: str):
    return F.expr(f"unix_millis({name})").alias(alias)


def tag_users(rows: DataFrame) -> DataFrame:
    """A processing step: user ids with a prefix."""
    return rows.withColumn("user_id", F.concat(F.lit("user-"), "user_id"))


CDC = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) // 1000 AS ms,
         CASE WHEN event_id % 97 = 0 THEN 'd' WHEN event_id % 7 = 0 THEN 'c'
              WHEN event_id % 11 = 0 THEN 'r' ELSE 'u' END AS op
  FROM events),
c AS (
  SELECT *,
         CASE op WHEN 'd' THEN 'DELETE' WHEN 'u' THEN 'UPDATE' ELSE 'INSERT' END AS operation,
         'eventdb.public.' || event_type AS topic,
         CAST(user_id % 6 AS INTEGER) AS part,
         op <> 'd' AS has_after, op IN ('u', 'd') AS has_before,
         CASE WHEN user_id = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS id_json,
         '"' || event_type || '"' AS a_type,
         CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE '"none"' END AS b_type,
         regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS a_value,
         CASE WHEN event_id % 3 = 0 THEN regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')
              ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS b_value,
         CAST(k AS VARCHAR) AS a_k,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS b_k
  FROM e),
m AS (SELECT * FROM c WHERE event_id % 103 <> 0),
g AS (SELECT * FROM m WHERE event_id % 101 <> 0)
"""

# Column changes: one row per event and column whose old and new JSON differ.
CHANGES = (
    CDC
    + """, x AS (
  SELECT event_id, topic, part, ms, operation, event_type, user_id, col,
         CASE WHEN operation = 'INSERT' OR NOT has_before THEN NULL ELSE old END AS old_value,
         CASE WHEN operation = 'DELETE' OR NOT has_after THEN NULL ELSE new END AS new_value
  FROM (
    SELECT g.*, 'id' AS col, id_json AS old, id_json AS new FROM g
    UNION ALL SELECT g.*, 'event_type', b_type, a_type FROM g
    UNION ALL SELECT g.*, 'value', b_value, a_value FROM g
    UNION ALL SELECT g.*, 'k', b_k, a_k FROM g)),
h AS (SELECT * FROM x WHERE old_value IS DISTINCT FROM new_value)
"""
)
