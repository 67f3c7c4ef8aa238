"""Tables laid out by several columns at once, and scans that leave files out by ranges of any of them.

A value becomes its rank among cuts of a sample, and the bits of the ranks are interleaved to one key.
Rows near each other in that order are near in every column, so a file spans a short range of each: the
timeline of a record and a page by time both read few files. A value that holds many rows takes one rank,
inside which the other columns go on splitting. The ranges of every file are kept in a small table, by
which a scan is planned without opening the files it leaves out.

Nulls rank first. No file is left out for being unknown: files written after the ranges are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.operators.retention import partition_by_month
from changetide.operators.substring import FILE, left_out


def cuts(df: DataFrame, columns: tuple[str, ...], bits: int = 6, sample_rows: int = 20_000) -> dict[str, list]:
    """At most 2^bits - 1 ascending cuts of each column, from about `sample_rows` distinct rows, twice that at most.

    Rows are chosen by a hash of the columns in the tasks that read them. Cuts only shape the layout."""
    share = min(1.0, (sample_rows + 30) / max(df.count(), 1))
    place = F.pmod(F.xxhash64(*columns), F.lit(2**40))
    sample = df.where(place < int(share * 2**40)).select(*columns).distinct().limit(2 * sample_rows).collect()
    found = {}
    for column in columns:
        values = sorted(r[column] for r in sample if r[column] is not None)
        found[column] = sorted({values[len(values) * i // 2**bits] for i in range(1, 2**bits)} if values else ())
    return found


def _rank(column: Column, bounds: list, low: int, high: int) -> Column:
    """How many of the cuts are not above the value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    upper = _rank(column, bounds, middle + 1, high)
    return F.when(column < F.lit(bounds[middle]), _rank(column, bounds, low, middle)).otherwise(upper)


def curve_key(bounds: dict[str, list], bits: int = 6) -> Column:
    """The interleaved bits of the columns' ranks, as a long."""
    if bits * len(bounds) > 62:
        raise ValueError("the ranks don't fit into a long")
    key = F.lit(0).cast("long")
    for at, (column, own) in enumerate(bounds.items()):
        rank = F.when(F.col(column).isNull(), 0).otherwise(_rank(F.col(column), own, 0, len(own))).cast("long")
        for bit in range(bits):
            place = bit * len(bounds) + len(bounds) - 1 - at
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("long")), place))
    return key


def write_table(
    df: DataFrame, path: str, time: str, columns: tuple[str, ...], bits: int = 6, files: int | None = None, mode: str = "append"
) -> None:
    """Store by month and, inside each month, along the curve over the columns.

    The input is read three times; store one that is costly to compute first. Equal keys are split by
    time, so a hot record becomes several files. `files`: how many ranges; as many as shuffles have if None."""
    keyed = partition_by_month(df, time).withColumn("__key", curve_key(cuts(df, columns, bits), bits))
    by = ("month", "__key", time)
    ranged = keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).drop("__key").write.mode(mode).partitionBy("month").parquet(path)


def ranges_by_file(stored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(file, low_<column>, high_<column>, …) of every file of a stored table that has rows."""
    parts = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]
    return stored.select(F.col(FILE).alias("file"), *columns).groupBy("file").agg(*parts)


def between(stored: DataFrame, ranges: DataFrame, max_files: int = 100_000, **bounds: tuple) -> DataFrame:
    """The rows whose columns lie within bounds, both inclusive; None leaves a side open.

    Up to `max_files` files outside the bounds are left out of the scan; further ones are read and filtered."""
    outside, inside = F.lit(False), F.lit(True)
    for column, (low, high) in bounds.items():
        # a file without a value in the column holds no match either
        if low is not None:
            outside |= F.coalesce(F.col(f"high_{column}") < F.lit(low), F.lit(True))
            inside &= F.col(column) >= F.lit(low)
        if high is not None:
            outside |= F.coalesce(F.col(f"low_{column}") > F.lit(high), F.lit(True))
            inside &= F.col(column) <= F.lit(high)
    return left_out(stored, ranges.where(outside).select("file"), max_files).where(inside)
