"""Source manifests: subscribed topics and rule violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.functions import values as V

# Field lists and name patterns of a connector entry.
REQUIRED = ("source_name", "database_hostname", "tables")
ALLOWED = (
    "source_name",
    "database_hostname",
    "tables",
    "enabled",
    "connector_name",
    "slot_name",
    "history_topic",
    "config_overrides",
)
SOURCE_PATTERN = "^[a-zA-Z0-9_-]+$"
TABLE_PATTERN = "^[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_-]+$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest document: path and the document as VARIANT."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), V.parse_json(F.col("value")).alias("manifest")
    )


def connectors(manifests: DataFrame) -> DataFrame:
    """One row per connector entry, in manifest order."""
    entries = F.try_variant_get(F.col("manifest"), "$.connectors", "array<variant>")
    return manifests.select("path", F.posexplode(entries).alias("index", "connector"))


def subscribed_topics(entries: DataFrame) -> DataFrame:
    """``source.table`` of enabled connectors: distinct, in manifest order."""
    c = F.col("connector")
    enabled = V.json(c, "enabled")
    rows = entries.where(
        (enabled.isNull() | ~enabled.isin(*V.EMPTY_JSON)) & V.given_text(c, "source_name").isNotNull()
    ).select(
        "path",
        "index",
        V.text(c, "source_name").alias("source"),
        F.posexplode(F.try_variant_get(c, "$.tables", "array<variant>")).alias("place", "table"),
    )
    table = F.try_variant_get(F.col("table"), "$", "string")
    texts = rows.where(F.to_json("table").startswith('"') & (table != ""))
    return (
        texts.groupBy(F.concat_ws(".", "source", table).alias("topic"))
        .agg(F.min(F.struct("path", "index", "place")).alias("first"))
        .orderBy("first")
        .select("topic")
    )


# The texts of violations below are fixed values: users' tools look for them.


def root_violations(manifests: DataFrame) -> DataFrame:
    """Broken rules of the document itself."""
    m = F.col("manifest")
    keys = F.map_keys(F.try_variant_get(m, "$", V.ROW_TYPE))
    extra = F.array_sort(F.array_except(keys, F.array(F.lit("connectors"))))
    entries = F.try_variant_get(m, "$.connectors", "array<variant>")
    found = F.array_compact(
        F.array(
            F.when(F.size(extra) > 0, F.concat(F.lit("Unknown root fields: "), F.array_join(extra, ", "))),
            F.when(
                entries.isNull() | (F.size(entries) == 0),
                F.lit("'connectors' must be a non-empty array."),
            ),
        )
    )
    checked = F.when(keys.isNull(), F.array(F.lit("Manifest root must be a JSON object."))).otherwise(found)
    return manifests.select("path", F.explode(checked).alias("violation"))


def violations(entries: DataFrame) -> DataFrame:
    """One row per broken rule of a connector entry."""
    c = F.col("connector")
    at = F.concat(F.lit("connectors["), F.col("index").cast("string"), F.lit("]"))
    keys = F.map_keys(F.try_variant_get(c, "$", V.ROW_TYPE))
    lit_array = lambda names: F.array(*(F.lit(n) for n in sorted(names)))
    is_text = lambda name: F.coalesce(V.json(c, name).startswith('"'), F.lit(False))
    given = lambda name: F.coalesce(V.json(c, name) != "null", F.lit(False))

    missing = F.array_except(lit_array(REQUIRED), keys)
    unknown = F.array_sort(F.array_except(keys, lit_array(ALLOWED)))
    tables = F.try_variant_get(c, "$.tables", "array<variant>")
    bad_tables = F.filter(
        F.transform(
            tables,
            lambda t, i: F.when(
                ~(
                    F.to_json(t).startswith('"')
                    & F.coalesce(F.try_variant_get(t, "$", "string").rlike(TABLE_PATTERN), F.lit(False))
                ),
                F.concat(at, F.lit(".tables["), i.cast("string"), F.lit("] must match "), F.lit(TABLE_PATTERN)),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    singles = [
        F.when(
            F.size(missing) > 0,
            F.concat(at, F.lit(" missing required fields: "), F.array_join(missing, ", ")),
        ),
        F.when(
            F.size(unknown) > 0,
            F.concat(at, F.lit(" has unknown fields: "), F.array_join(unknown, ", ")),
        ),
        F.when(
            ~(is_text("source_name") & F.coalesce(V.text(c, "source_name").rlike(SOURCE_PATTERN), F.lit(False))),
            F.concat(at, F.lit(".source_name must match " + SOURCE_PATTERN)),
        ),
        F.when(
            ~(is_text("database_hostname") & (V.text(c, "database_hostname") != "")),
            F.concat(at, F.lit(".database_hostname must be a non-empty string")),
        ),
        F.when(
            tables.isNull() | (F.size(tables) == 0),
            F.concat(at, F.lit(".tables must be a non-empty array")),
        ),
        F.when(
            given("enabled") & ~V.json(c, "enabled").isin("true", "false"),
            F.concat(at, F.lit(".enabled must be a boolean")),
        ),
        *(
            F.when(given(n) & ~is_text(n), F.concat(at, F.lit(f".{n} must be a string")))
            for n in ("connector_name", "slot_name", "history_topic")
        ),
        F.when(
            given("config_overrides") & V.as_row(c, "config_overrides").isNull(),
            F.concat(at, F.lit(".config_overrides must be an object")),
        ),
    ]
    found = F.concat(
        F.array_compact(F.array(*singles)), F.coalesce(bad_tables, F.array().cast("array<string>"))
    )
    checked = F.when(keys.isNull(), F.array(F.concat(at, F.lit(" must be an object.")))).otherwise(found)
    return entries.select("path", "index", F.explode(checked).alias("violation"))
