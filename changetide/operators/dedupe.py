"""Exactly one stored row per broker position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.schemas import POSITION


def split_positions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a full position, and rows that can never conflict."""
    full = F.lit(True)
    for name in POSITION:
        full = full & F.col(name).isNotNull()
    return df.where(full), df.where(~full)


def distinct_positions(df: DataFrame) -> DataFrame:
    """One row per position; copies collapse inside each task before the shuffle.

    Rows without a full position are all kept and take no part in the shuffle.
    """
    known, unknown = split_positions(df)
    return known.dropDuplicates(list(POSITION)).unionByName(unknown)


def new_positions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-ignore: the rows of a batch whose position is not stored yet."""
    known, unknown = split_positions(batch)
    fresh = known.dropDuplicates(list(POSITION)).join(
        stored.select(*POSITION), list(POSITION), "left_anti"
    )
    return fresh.unionByName(unknown)


def inserted_events(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """The events of a batch whose position was inserted."""
    return batch.join(inserted.select(*POSITION), list(POSITION), "left_semi")
