"""Row identity of a change event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetide.functions import values as V


def row_identity(after: Column, before: Column, key_columns: Column | None = None) -> Column:
    """Canonical JSON of the identifying columns of a row, NULL when it has none.

    ``after`` and ``before`` are key → VARIANT maps. A column identifies when it is declared as
    a key or has "id" in its name; canonical JSON sorts, so the order of preference is moot.
    """
    row = F.coalesce(after, before)

    def identifies(name: Column, value: Column) -> Column:
        by_name = F.lower(name).contains("id")
        if key_columns is not None:
            by_name = by_name | F.coalesce(F.array_contains(key_columns, name), F.lit(False))
        return by_name & value.isNotNull() & ~F.is_variant_null(value)

    # Bound, or both versions of the row are read and filtered once to be counted and once to be printed.
    return V.let(F.map_filter(row, identifies), lambda kept: F.when(F.size(kept) > 0, V.canonical_json(kept)))
