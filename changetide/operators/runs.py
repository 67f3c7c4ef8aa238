"""Positions as runs of offsets: (topic, partition, span, first_offset, last_offset).

A broker hands out offsets one after the other, so what a table has stored of a partition is a few runs
with gaps between them, however many events that were. Runs end at the borders of spans of ``SPAN``
offsets, so that a search for some positions reads the spans they lie in and nothing else. Searching
deals positions out by blocks of ``BLOCK`` offsets: a run is offered to the blocks it crosses, and inside
a block there are never more than half as many runs as offsets, which bounds the comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.operators.dedupe import split_positions

SPAN = 1_000_000
BLOCK = 4_096

_STREAM = ("topic", "partition")


def span_of(offset: Column) -> Column:
    return F.floor(offset / SPAN)


def _merged(pieces: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Runs that touch or overlap become one, inside each group of `within`."""
    group = W.partitionBy(*within).orderBy("first_offset", "last_offset")
    before = F.max("last_offset").over(group.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce(F.col("first_offset") > before + 1, F.lit(True)).cast("int")
    numbered = pieces.withColumn("_starts", starts).withColumn(
        "_run", F.sum("_starts").over(group.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return (
        numbered.groupBy(*within, "_run")
        .agg(F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))
        .drop("_run")
    )


def merged_runs(runs: DataFrame) -> DataFrame:
    """The same positions in as few runs as possible."""
    return _merged(runs, (*_STREAM, "span"))


def runs_of(positions: DataFrame) -> DataFrame:
    """Runs of the full positions among some rows, repeated ones included.

    Runs form inside blocks first, each at most ``BLOCK`` offsets, and only their ends are merged by span."""
    known, _ = split_positions(positions)
    offset = F.col("offset")
    block = F.floor(offset / BLOCK)
    single = known.select(*_STREAM, span_of(offset).alias("span"), block.alias("_block"), "offset").distinct()
    group = W.partitionBy(*_STREAM, "span", "_block").orderBy("offset")
    islands = single.withColumn("_island", offset - F.row_number().over(group))
    pieces = islands.groupBy(*_STREAM, "span", "_block", "_island").agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )
    return merged_runs(pieces.drop("_block", "_island"))


def new_positions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-ignore against runs: one row for each position of a batch that no run holds.

    Rows without a full position are all kept."""
    known, unknown = split_positions(batch)
    blocks = F.sequence(F.floor(F.col("first_offset") / BLOCK), F.floor(F.col("last_offset") / BLOCK))
    offered = stored.select(
        F.col("topic").alias("_topic"),
        F.col("partition").alias("_partition"),
        F.explode(blocks).alias("_block"),
        F.col("first_offset").alias("_first"),
        F.col("last_offset").alias("_last"),
    )
    single = known.dropDuplicates([*_STREAM, "offset"])
    held = (
        (F.col("topic") == F.col("_topic"))
        & (F.col("partition") == F.col("_partition"))
        & (F.floor(F.col("offset") / BLOCK) == F.col("_block"))
        & F.col("offset").between(F.col("_first"), F.col("_last"))
    )
    return single.join(offered, held, "left_anti").unionByName(unknown)


def missing_runs(runs: DataFrame) -> DataFrame:
    """The gaps between the first and the last stored position of each partition."""
    whole = W.partitionBy(*_STREAM).orderBy("first_offset")
    before = F.lag("last_offset").over(whole)
    gaps = merged_runs(runs).withColumn("_after", before)
    return gaps.where(F.col("first_offset") > F.col("_after") + 1).select(
        *_STREAM, (F.col("_after") + 1).alias("first_offset"), (F.col("first_offset") - 1).alias("last_offset")
    )
