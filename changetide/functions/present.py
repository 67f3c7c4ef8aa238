"""Readable forms of values, rows and events.

Rows are key → VARIANT maps. Everything here is a JVM expression; values nested deeper than the
first level are only rewritten by the Arrow functions in :mod:`changetide.functions.deep`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetide.functions import values as V

# Field-name tokens, magnitudes and label keys of the display rules.
TIME_TOKENS = "time|date|_at"
MICROS_FROM = 100_000_000_000_000
MILLIS_FROM = 10_000_000_000
MAX_MICROS = 253_402_300_799_999_999
LABEL_KEYS = (
    "email",
    "username",
    "name",
    "full_name",
    "display_name",
    "order_number",
    "customer_number",
    "tracking_number",
    "shipment_number",
    "sku",
    "product_name",
    "category_name",
    "title",
    "code",
)

_WIDE_BYTES = 15


def iso_text(ts: Column) -> Column:
    """UTC ISO-8601 text; the fraction appears only when it is not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


def time_like(number: Column, name: Column) -> Column:
    """Timestamp for an integer whose field name suggests one, else NULL."""
    x = number.try_cast("bigint")
    micros = (
        F.when(x >= MICROS_FROM, x)
        .when(x >= MILLIS_FROM, x * 1_000)
        .when(x > -62_135_596_800, x * 1_000_000)
    )
    named = F.lower(name).rlike(TIME_TOKENS)
    return F.when(named & (micros <= MAX_MICROS), F.timestamp_micros(micros))


def _point(integer: Column, scale: Column) -> Column:
    """Decimal text of an integer shifted by ``scale`` places."""
    digits = F.regexp_replace(integer.cast("string"), "^-", "")

    def placed(d: Column) -> Column:
        padded = F.lpad(d, F.greatest(F.length(d), scale + 1), F.lit("0"))
        whole = F.length(padded) - scale
        return (
            F.when(
                scale > 0,
                F.concat(F.left(padded, whole), F.lit("."), F.right(padded, scale)),
            )
            .when((scale < 0) & (d != "0"), F.concat(d, F.repeat(F.lit("0"), -scale)))
            .otherwise(d)
        )

    return F.concat(F.when(integer < 0, "-").otherwise(""), V.let(digits, placed))


def _signed(body: Column) -> Column:
    """Big-endian two's complement of up to 15 bytes as a decimal."""
    hexed = F.lpad(F.hex(body), 2 * _WIDE_BYTES, "0")
    low = F.conv(F.right(hexed, F.lit(16)), 16, 10).cast("decimal(20,0)")
    high = F.conv(F.left(hexed, F.lit(2 * _WIDE_BYTES - 16)), 16, 10).cast("decimal(17,0)")
    unsigned = (high * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + low
    negative = F.substring(F.hex(body), 1, 1) >= "8"
    spans = F.array(
        *(F.lit(str(2 ** (8 * n))).cast("decimal(38,0)") for n in range(1, _WIDE_BYTES + 1))
    )
    return F.when(negative, unsigned - F.try_element_at(spans, F.length(body))).otherwise(
        unsigned
    ).cast("decimal(38,0)")


def decimal_text(v: Column) -> Column:
    """Decode ``{"scale": n, "value": base64}`` of up to 15 bytes; NULL for anything else."""
    fields = F.array_sort(F.map_keys(F.try_variant_get(v, "$", V.ROW_TYPE)))
    parts = F.struct(
        (fields == F.array(F.lit("scale"), F.lit("value"))).alias("shaped"),
        F.try_variant_get(v, "$.scale", "int").alias("scale"),
        F.try_to_binary(F.try_variant_get(v, "$.value", "string"), F.lit("base64")).alias("body"),
    )

    def decoded(p: Column) -> Column:
        width = F.length(p["body"])
        text = V.let(_signed(p["body"]), lambda n: _point(n, p["scale"]))
        return F.when(
            p["shaped"] & p["scale"].isNotNull(),
            F.when(width == 0, "0").when(width <= _WIDE_BYTES, text),
        )

    return V.let(parts, decoded)


def shown(v: Column, name: Column) -> Column:
    """Display text of a value under its field name."""

    def text(doc: Column) -> Column:
        return (
            F.when(doc.isNull() | (doc == "null"), "null")
            .when(doc.startswith("{"), F.coalesce(decimal_text(v), doc))
            .when(doc.startswith("["), doc)
            .when(doc.isin("true", "false"), F.initcap(doc))
            .when(
                doc.rlike("^-?[0-9]+$"),
                F.coalesce(V.let(time_like(doc, name), iso_text), doc),
            )
            .otherwise(F.try_variant_get(v, "$", "string"))
        )

    return V.let(F.to_json(v), text)


def truncated(value: Column, limit: int = 64) -> Column:
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.left(value, F.lit(limit - 1)), F.lit("..."))
    )


def relative_age(ts: Column, now: Column) -> Column:
    """Compact age such as ``5m ago`` or ``in 2h``."""
    delta = F.expr("0").cast("bigint") + F.floor(
        F.abs(F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000
    )
    label = (
        F.when(delta < 60, F.concat(delta.cast("string"), F.lit("s")))
        .when(delta < 3_600, F.concat(F.floor(delta / 60).cast("string"), F.lit("m")))
        .when(delta < 86_400, F.concat(F.floor(delta / 3_600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(delta / 86_400).cast("string"), F.lit("d")))
    )
    ahead = (F.unix_micros(now) - F.unix_micros(ts)) <= -1_000_000
    return (
        F.when(ts.isNull(), "unknown")
        .when(ahead, F.concat(F.lit("in "), label))
        .otherwise(F.concat(label, F.lit(" ago")))
    )


def time_label(ts: Column, now: Column, compact: bool = False) -> Column:
    """Absolute and relative time together."""
    absolute = F.date_format(ts, "HH:mm:ss") if compact else iso_text(ts)
    return F.when(ts.isNull(), "unknown").otherwise(
        F.concat(absolute, F.lit(" ("), relative_age(ts, now), F.lit(")"))
    )


def all_fields(before: Column, after: Column) -> Column:
    """Keys of both row versions, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(
        F.array_union(F.coalesce(F.map_keys(before), none), F.coalesce(F.map_keys(after), none))
    )


def state_pairs(before: Column, after: Column, limit: int = 28) -> Column:
    """Every field with its value before and after, shortened for display."""
    return F.transform(
        all_fields(before, after),
        lambda k: F.struct(
            k.alias("field"),
            truncated(shown(F.try_element_at(before, k), k), limit).alias("before"),
            truncated(shown(F.try_element_at(after, k), k), limit).alias("after"),
        ),
    )


def diff_triples(before: Column, after: Column) -> Column:
    """Changed fields in name order as (field, old, new) display texts."""
    pairs = F.transform(
        all_fields(before, after),
        lambda k: F.struct(
            k.alias("field"),
            F.try_element_at(before, k).alias("old"),
            F.try_element_at(after, k).alias("new"),
        ),
    )
    changed = F.filter(
        pairs,
        lambda p: ~V.same_value(V.sql_null(F.to_json(p["old"])), V.sql_null(F.to_json(p["new"]))),
    )
    return F.transform(
        changed,
        lambda p: F.struct(
            p["field"].alias("field"),
            shown(p["old"], p["field"]).alias("old"),
            shown(p["new"], p["field"]).alias("new"),
        ),
    )


def change_summary(triples: Column, operation: Column) -> Column:
    """One line on what an event changed."""
    known = F.coalesce(F.when(operation != "", operation), F.lit("UPDATE"))

    def line(t: Column) -> Column:
        first = F.get(t, F.lit(0))
        names = F.array_join(F.transform(t, lambda x: x["field"]), ", ")
        return (
            F.when(F.size(t) == 0, F.concat(F.initcap(known), F.lit(" event")))
            .when(
                F.size(t) == 1,
                F.concat(first["field"], F.lit(": "), first["old"], F.lit(" -> "), first["new"]),
            )
            .when(F.size(t) <= 3, F.concat(names, F.lit(" changed")))
            .otherwise(F.concat(F.size(t).cast("string"), F.lit(" fields changed")))
        )

    return V.let(triples, line)


def operation_label(operation: Column) -> Column:
    known = F.coalesce(F.nullif(operation, F.lit("")), F.lit("UPDATE"))
    upper = F.upper(known)
    return (
        F.when(upper == "INSERT", "+ INSERT")
        .when(upper == "UPDATE", "~ UPDATE")
        .when(upper == "DELETE", "- DELETE")
        .otherwise(known)
    )


def table_label(service: Column, table: Column) -> Column:
    return F.coalesce(
        F.concat(service, F.lit("."), table), table, service, F.lit("unknown")
    )


def snapshot(before: Column, after: Column) -> Column:
    """Row as it stands after the event: after, else before."""
    return F.coalesce(after, before)


def record_label(before: Column, after: Column, identity: Column | None = None) -> Column:
    """At most two ``key=value`` parts: a business key, then identity keys."""
    none = F.from_json(F.lit(None).cast("string"), V.ROW_TYPE) if identity is None else identity
    row = F.coalesce(F.when(F.size(after) > 0, after), F.when(F.size(before) > 0, before), none)
    stored = F.coalesce(F.map_keys(none), F.array().cast("array<string>"))
    merged = (
        row
        if identity is None
        else F.coalesce(
            F.map_concat(F.map_filter(row, lambda k, _: ~F.array_contains(stored, k)), none), row
        )
    )
    return F.coalesce(V.let(merged, _label), F.lit("unknown"))


def _label(row: Column) -> Column:
    names = F.array_sort(F.map_keys(row))
    preferred = F.slice(
        F.filter(
            F.array(*(F.lit(k) for k in LABEL_KEYS)),
            lambda k: F.coalesce(~F.to_json(F.try_element_at(row, k)).isin("null", '""'), F.lit(False)),
        ),
        1,
        1,
    )
    keyed = F.array_distinct(
        F.concat(
            F.filter(names, lambda k: k == "id"),
            F.filter(names, lambda k: k.endswith("_id")),
            F.filter(names, lambda k: F.lower(k).contains("id")),
        )
    )
    given = F.filter(names, lambda k: ~F.is_variant_null(F.try_element_at(row, k)))
    others = V.let(keyed, lambda ks: F.when(F.size(ks) > 0, ks).otherwise(given))
    chosen = F.slice(F.array_distinct(F.concat(preferred, others)), 1, 2)
    parts = F.transform(
        chosen, lambda k: F.concat(k, F.lit("="), shown(F.try_element_at(row, k), k))
    )
    return V.let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, ", ")).otherwise("unknown"))
