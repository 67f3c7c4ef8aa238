"""Column history as intervals: which value a column of a row had from when to when.

A change holds until the next one of its row and column, the last one without end. With that worked out
beforehand, the state of every row at a time is a filter on two columns, which the files' statistics
serve, and a lookup meets the one interval it falls into. Intervals are kept up by batch: late changes cut
the interval they fall into, and only rows that the batch touches are worked out again.

Changes of one instant count by position, so the last of them holds. Changes without a time or with a
null in their key are left out. A key with very many changes is cut into slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.operators import ordered
from changetide.schemas import POSITION_ORDER

KEY = ("table_id", "column_name", "row_identity")


def _cut(starts: DataFrame, keys: Sequence[str], slicing: ordered.Slicing) -> DataFrame:
    """Intervals from rows with valid_from, the last position of an instant winning."""
    hit = F.struct("new_value", *POSITION_ORDER)
    single = starts.groupBy(*keys, "valid_from").agg(F.max_by(hit, F.struct(*POSITION_ORDER)).alias("_hit"))
    # the latest start before an instant, told backwards in time, is the next one after it
    back = single.withColumn("_back", -F.unix_micros("valid_from"))
    ends = ordered.carry_last(back, keys, "_back", F.col("valid_from"), "valid_to", (), inclusive=False, slicing=slicing)
    return ends.select(*keys, "valid_from", "valid_to", "_hit.*")


def intervals(
    changes: DataFrame, keys: Sequence[str] = KEY, slicing: ordered.Slicing = ordered.DEFAULT
) -> DataFrame:
    """(keys…, valid_from, valid_to, new_value, position…); valid_to is null where the value still holds."""
    known = changes.where(F.col("changed_at").isNotNull()).dropna(subset=list(keys))
    starts = known.select(*keys, F.col("changed_at").alias("valid_from"), "new_value", *POSITION_ORDER)
    return _cut(starts, keys, slicing)


def merged(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str] = KEY, slicing: ordered.Slicing = ordered.DEFAULT
) -> DataFrame:
    """Stored intervals with those of a batch worked in; rows the batch doesn't touch stay as they are."""
    touched = batch.select(*keys).distinct()
    again = stored.join(touched, list(keys), "left_semi").unionByName(batch)
    return stored.join(touched, list(keys), "left_anti").unionByName(_cut(again.drop("valid_to"), keys, slicing))


def snapshot(history: DataFrame, at: datetime) -> DataFrame:
    """What every row and column held at a time."""
    moment = F.lit(at)
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def values_at(history: DataFrame, lookups: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """As-of values for (keys…, at) lookups: value, changed_at and found, as ``changes.values_at`` gives."""
    named = history.select(*(F.col(k).alias("_r_" + k) for k in keys), "valid_from", "valid_to", F.col("new_value").alias("value"))
    inside = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))
    joined = lookups.join(named, ordered.same_keys(lookups, named, keys, "_r_") & inside, "left")
    return joined.select(
        *lookups.columns, "value", F.col("valid_from").alias("changed_at"), F.col("valid_from").isNotNull().alias("found")
    )
