"""Access to VARIANT payloads and the canonical JSON text of their values.

Canonical text (object keys sorted, no blanks) is what operators compare, group by and
store, because VARIANT itself can be neither grouped nor compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON texts that count as "not given" in a chain of alternatives.
EMPTY_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")
# The same as texts, without the quotes of a string.
EMPTY_TEXT = ("", "0", "0.0", "-0.0", "false", "[]", "{}")

ROW_TYPE = "map<string,variant>"


def path(name: str) -> str:
    return f"$.{name}"


def member(v: Column, name: str) -> Column:
    """Member of an object as VARIANT; SQL NULL when absent."""
    return F.try_variant_get(v, path(name), "variant")


def rare_member(v: Column, name: str) -> Column:
    """The same for a member that most objects lack: they are read through, no path leads nowhere."""
    return F.try_variant_get(v, "$", f"struct<{name}:variant>")[name]


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def text(v: Column, name: str) -> Column:
    """Member as text; JSON null and absent give NULL, nested values their JSON."""
    return F.try_variant_get(v, path(name), "string")


def json(v: Column, name: str) -> Column:
    """Canonical JSON of a member; a JSON null is the text ``null``."""
    return F.to_json(member(v, name))


def as_row(v: Column, name: str) -> Column:
    """Object member as a key → VARIANT map; NULL for anything that is no object."""
    return F.try_variant_get(v, path(name), ROW_TYPE)


def given_json(v: Column, name: str) -> Column:
    """Canonical JSON of a member, NULL when empty, zero, false or null."""
    return nonempty(json(v, name))


def given_text(v: Column, name: str) -> Column:
    """Text of a member, NULL when empty, zero, false or null."""
    return F.when(given_json(v, name).isNotNull(), text(v, name))


def nonempty(json_text: Column) -> Column:
    """Canonical JSON, NULL when it denotes something empty, zero, false or null."""
    return F.when(~json_text.isin(*EMPTY_JSON), json_text)


def given(value: Column, document: Column, at: str) -> Column:
    """Already extracted text of a member, NULL when empty, zero, false or null.

    Only a text that looks empty is looked up again, to tell the string "0" from the number 0. One that
    is absent is not: a path that leads nowhere costs Spark more than the rest of the parse.
    """
    looks_empty = value.isin(*EMPTY_TEXT)
    is_string = F.to_json(F.try_variant_get(document, at, "variant")).startswith('"')
    return F.when(value.isNull(), F.lit(None)).when(~looks_empty, value).when((value != "") & is_string, value)


def text_of(v: Column) -> Column:
    """Text of a VARIANT; JSON null gives NULL, nested values their JSON."""
    return F.try_variant_get(v, "$", "string")


def first_filled(*texts: Column) -> Column:
    """First text that is not blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(t) != "", F.trim(t)) for t in texts))


def members(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, dict[str, Column]]:
    """Unfold a struct column into plain columns, and name them.

    Members referenced inside a later :func:`computed` must be plain columns: the optimizer moves
    struct members below generators and then misses columns that are still needed above.
    """
    names = [part.split(":")[0] for part in kind.removeprefix("struct<").removesuffix(">").split(",")]
    plain = {name: f"{column}_{name}" for name in names}
    unfolded = df.select(
        *(c for c in df.columns if c != column),
        F.col(column).isNotNull().alias(f"{column}_found"),
        *(F.col(column)[name].alias(alias) for name, alias in plain.items()),
    )
    return unfolded, {name: F.col(alias) for name, alias in plain.items()}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value, so that an expression using it often neither repeats nor re-evaluates it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_json(raw: Column) -> Column:
    """Parse to VARIANT; text that is not JSON gives NULL."""
    return F.try_parse_json(raw)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection may be merged into every later expression and filter that uses it, which
    would parse a document many times over. The output of a generator is never rewritten so.
    """
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def canonical_json(row: Column) -> Column:
    """Canonical JSON of a key → VARIANT map."""
    return F.to_json(F.to_variant_object(row))


def canonical_values(row: Column) -> Column:
    """Key → VARIANT map as key → canonical JSON text map."""
    return F.transform_values(row, lambda _, x: F.to_json(x))


def sql_null(json_text: Column) -> Column:
    """JSON null becomes SQL NULL, so that it equals an absent key."""
    return F.nullif(json_text, F.lit("null"))


def same_value(a: Column, b: Column) -> Column:
    """Equality of canonical JSON texts; a float form equals the integer it denotes."""
    float_form = F.coalesce(a.rlike("^-?[0-9]+[.eE]"), F.lit(False)) | F.coalesce(
        b.rlike("^-?[0-9]+[.eE]"), F.lit(False)
    )
    as_numbers = F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))
    return a.eqNullSafe(b) | (float_form & as_numbers)


def json_kind(v: Column) -> Column:
    """Type name of a VARIANT value in the catalog's vocabulary."""
    return let(
        F.schema_of_variant(v),
        lambda kind: F.when(kind.isNull() | (kind == "VOID"), "unknown")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("string"),
    )
